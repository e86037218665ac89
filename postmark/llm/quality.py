"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of character and word statistics. Cyclic boosting visits one
feature at a time with a shallow tree over its bins and adds the tree to that feature's
lookup table; the strongest pairs then get two-way tables the same way. A score is the
logistic of the intercept plus one table entry for each feature and pair.

Empty and null texts have all statistics zero and are scored like any other row. Labels
with a null id or null quality, or whose document is absent, teach nothing; a document
labelled more than once counts once for each label. With no usable label, or labels of one
class only, the model is the constant prior (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import read

#: The most labelled rows the model is fitted on; beyond that, the rows of least hash.
SAMPLE = 20_000
#: Score from which a document is kept.
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "log_lines", "upper_share", "symbol_share", "odd_symbol_share", "bang_rate", "bar_rate", "comma_rate", "stop_rate",
    "digit_share", "wide_share", "word_length", "distinct_share", "repeat_share", "capital_share", "shout_share", "marked_share", "line_words",
    "stopped_lines", "space_share", "top_share", "line_spread",
)
_CLASS = np.zeros(256, np.uint8)
for _c, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'-\"()?", b"!", b"|"), 1):
    _CLASS[list(_members)] = _c
_CLASS[128:] = 8
_UPPER, _LOWER, _DIGIT, _SPACE, _PLAIN, _BANG, _BAR, _WIDE, _ODD = 1, 2, 3, 4, 5, 6, 7, 8, 0


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each text, float32, one row a text."""
    n = len(offsets) - 1
    kinds = _CLASS[data]
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(row_of * 9 + kinds, minlength=9 * n).reshape(n, 9).astype(np.float64)
    per = lambda x: np.bincount(x, minlength=n).astype(np.float64)
    size = np.diff(offsets).astype(np.float64)
    start, end, row = K.words(data, offsets, K.NONSPACE)
    h = K.hashes(data, start, end)
    n_words = per(row)
    same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])))) if len(hs) else np.zeros(0, np.int64)
    runs = np.diff(np.append(new, len(hs)))
    top = np.zeros(n)
    np.maximum.at(top, rs[new], runs)
    distinct = per(rs[new])
    first, last = kinds[start] if len(start) else kinds[:0], kinds[end - 1] if len(start) else kinds[:0]
    before_last = kinds[np.maximum(end - 2, start)] if len(start) else kinds[:0]
    shout = (first == _UPPER) & (kinds[np.minimum(start + 1, end - 1)] == _UPPER) if len(start) else np.zeros(0, bool)
    marked = np.isin(last, (_ODD, _BANG, _BAR)) & np.isin(before_last, (_ODD, _BANG, _BAR)) if len(start) else np.zeros(0, bool)
    breaks = np.flatnonzero(data == 10)
    lines = per(row_of[breaks]) + (size > 0)
    ended = per(row_of[breaks[np.isin(data[np.maximum(breaks - 1, 0)], (46, 63))]]) if len(breaks) else np.zeros(n)
    tail = np.flatnonzero(size > 0)
    ended[tail] += np.isin(data[offsets[1:][tail] - 1], (46, 63))
    # the longest line of a text against the mean one
    line_start = np.sort(np.concatenate((offsets[:-1][tail], breaks + 1)))
    line_start = np.unique(line_start[line_start < len(data)])
    longest = np.zeros(n)
    if len(line_start):
        np.maximum.at(longest, row_of[line_start], np.diff(np.append(line_start, len(data))))
    letters, words_, bytes_ = np.maximum(count[:, _UPPER] + count[:, _LOWER], 1), np.maximum(n_words, 1), np.maximum(size, 1)
    comma, stop = per(row_of[np.flatnonzero(data == 44)]), per(row_of[np.flatnonzero(data == 46)])
    out = np.column_stack((
        np.log1p(size), np.log1p(n_words), np.log1p(lines), count[:, _UPPER] / letters, (count[:, _PLAIN] + count[:, _ODD] + count[:, _BANG] + count[:, _BAR]) / bytes_,
        count[:, _ODD] / bytes_, count[:, _BANG] / words_, count[:, _BAR] / words_, comma / words_, stop / words_, count[:, _DIGIT] / bytes_, count[:, _WIDE] / bytes_,
        (bytes_ - count[:, _SPACE]) / words_, distinct / words_, per(row[same + 1]) / words_ if len(same) else np.zeros(n), per(row[first == _UPPER]) / words_,
        per(row[shout]) / words_, per(row[marked]) / words_, n_words / np.maximum(lines, 1), ended / np.maximum(lines, 1), count[:, _SPACE] / bytes_, top / words_,
        longest * np.maximum(lines, 1) / bytes_,
    ))
    out[size == 0] = 0
    return out.astype(np.float32)


@dataclass
class Additive:
    """The fitted model: bin borders and a lookup table for each feature, and tables for pairs."""

    intercept: float
    borders: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(b, x[:, j], side="right") for j, b in enumerate(self.borders)]) if self.borders else np.zeros((len(x), 0), int)

    def logit(self, x: np.ndarray) -> np.ndarray:
        f, b = np.full(len(x), self.intercept), self.bins(x)
        for j, t in enumerate(self.tables):
            f += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            f += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return f

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow tree over ordered bins: the best cut, then the best cuts within, up to ``leaves`` pieces."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    pieces = [(0, len(g))]
    while len(pieces) < leaves:
        best = (1e-9, None, None)
        for a, b in pieces:
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                won = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(np.argmax(won))
                if won[k] > best[0]:
                    best = (won[k], (a, b), int(cuts[k]))
        if best[1] is None:
            break
        a, b = best[1]
        pieces.remove((a, b))
        pieces += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in pieces:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each axis of a two-way histogram: (gain, its table)."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = 0.0
    parts = []
    for rows in (lambda c: c[1:-1, :], lambda c: c[-1:, :] - c[1:-1, :]):
        for cols in (lambda c: c[:, 1:-1], lambda c: c[:, -1:] - c[:, 1:-1]):
            a, b = cols(rows(cg)), cols(rows(ch))
            parts.append(a / (b + ridge))
            total = total + a * a / (b + ridge)
    if not np.size(total):
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = (p[i, j] for p in parts)
    return float(total[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 150, rate: float = 0.08, n_pairs: int = 8, n_coarse: int = 8, leaves: int = 4, ridge: float = 1.0) -> Additive:
    """Cyclic gradient boosting on the logistic loss; single features first, then the strongest pairs on what they leave."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Additive(float(np.log(p / (1 - p))))
    p = y.mean()
    m = Additive(float(np.log(p / (1 - p))))
    m.borders = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = m.bins(x)
    sizes = [len(t) + 1 for t in m.borders]
    m.tables = [np.zeros(s) for s in sizes]
    m.coarse = [np.arange(s) * min(n_coarse, s) // s for s in sizes]
    f = np.full(len(y), m.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, s in enumerate(sizes):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s), leaves, ridge)
            m.tables[j] += step
            f += step[b[:, j]]
    cells = [c[b[:, j]] for j, c in enumerate(m.coarse)]
    widths = [int(c[-1]) + 1 for c in m.coarse]

    def histogram(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cells[i] * widths[j] + cells[j], v, widths[i] * widths[j]).reshape(widths[i], widths[j])

    g, h = slopes()
    gains = sorted(((_cross(histogram(i, j, g), histogram(i, j, h), ridge)[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    m.pairs = [(i, j) for won, i, j in gains[:n_pairs] if won > 0]
    m.pair_tables = [np.zeros((widths[i], widths[j])) for i, j in m.pairs]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(m.pairs):
            g, h = slopes()
            step = rate * _cross(histogram(i, j, g), histogram(i, j, h), ridge)[1]
            m.pair_tables[k] += step
            f += step[cells[i], cells[j]]
    return m


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<float>) for every row."""

    def run(batches):
        for b in K.slices(batches):
            x = features(*K.utf8(b.column("text")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), flat], names=["id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, stats array<float>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", where=None, sample: int = SAMPLE) -> Additive:
    """Fits on the labelled rows that ``where`` (a Column on doc_id) allows, at most ``sample`` of them."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    # rows that repeat a doc_id count once, so that no more rows are gathered than labels
    each = with_features(taught).groupBy("id").agg(F.min("stats").alias("stats"))
    got = each.join(F.broadcast(rows), "id").select("id", "y", "stats").toPandas().sort_values(["id", "y"], kind="stable")
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(got["stats"]).astype(np.float32), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Additive, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of every row with its score (0 to 1) and prediction (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        m = shared.value
        for b in K.slices(batches, "__text"):
            s = m.score(features(*K.utf8(b.column("__text"))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _fold():
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's quality score, taught by the labels outside the held-out fifth; a null doc_id isn't held out."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), where=_fold() != 0)
    return score(docs, model).select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns; only the text goes through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([text], names=["text"])
        found = [shared.value.score(features(*K.utf8(b.column("text")))) >= threshold for b in K.slices([rows])]
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(good("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents below the threshold go."""
    return accepted(docs, train(docs, read(spark, sf_dir, "labels"), where=_fold() != 0))
