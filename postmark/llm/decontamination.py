"""Benchmark decontamination by greedy string tiling.

Words shared seeds (runs of ``min_match`` words) join documents to benchmark items. For each joined
pair, the longest matches between stretches that no tile covers yet are found by running
Karp-Rabin hashes of a falling search length and laid as tiles, so a passage whose parts stand
in another order is still covered. A pair is a leak where tiles cover at least ``coverage`` of
the item's words.

Words are runs of ASCII letters and digits and of any other characters, A-Z lower-cased. Items of
fewer than ``min_match`` words, null or empty items and null or empty documents give no leak.
Repeated items or documents are reported each. The benchmark is broadcast in blocks of at most
``BLOCK_WORDS`` words (by expectation, an item's words stay together); a larger benchmark
takes more passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import read

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
_BASE = 0x2545F4914F6CDD1D


def _powers(n: int) -> np.ndarray:
    p = np.full(n + 1, _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _windows(h: np.ndarray, free: np.ndarray, size: int, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, rolling hash) of each window of ``size`` words without a marked one."""
    if len(h) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[: len(h)], out=total[1:])
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, (total[at + size] - total[at]) * powers[len(h) - at]


def tile(doc: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words), longest first; none overlap on either side."""
    powers = _powers(max(len(doc), len(item)))
    # both sides are shifted to the same power, so equal windows have equal hashes
    shift_d, shift_i = powers[max(len(item) - len(doc), 0)], powers[max(len(doc) - len(item), 0)]
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(min_match, min(20, len(item)))
    while True:
        at_i, h_i = _windows(item, free_i, size, powers)
        at_d, h_d = _windows(doc, free_d, size, powers)
        h_i, h_d = h_i * shift_i, h_d * shift_d
        order = np.argsort(h_i, kind="stable")
        h_i, at_i = h_i[order], at_i[order]
        low, high = np.searchsorted(h_i, h_d, "left"), np.searchsorted(h_i, h_d, "right")
        hit = np.flatnonzero(high > low)
        matches: list[tuple[int, int, int]] = []
        longest, seen = 0, set()
        for k in hit:
            d = int(at_d[k])
            for i in at_i[low[k] : high[k]].tolist():
                # only the first window of a run along its diagonal opens a match
                if (d - 1, i - 1) in seen:
                    seen.add((d, i))
                    continue
                if not np.array_equal(doc[d : d + size], item[i : i + size]):
                    continue
                seen.add((d, i))
                n = size
                while d + n < len(doc) and i + n < len(item) and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                matches.append((n, d, i))
                longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        queue = sorted(matches, key=lambda m: (-m[0], m[1], m[2]))
        while queue:
            n, d, i = queue.pop(0)
            ok = free_d[d : d + n] & free_i[i : i + n]
            if ok.all():
                free_d[d : d + n] = free_i[i : i + n] = False
                tiles.append((d, i, n))
            else:  # what earlier tiles left of it, if still long enough
                edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
                left = [(int(b - a), d + int(a), i + int(a)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= size]
                if left:
                    queue = sorted(queue + left, key=lambda m: (-m[0], m[1], m[2]))
        if size == min_match:
            return tiles
        size = max(min_match, size // 2)


@dataclass
class Items:
    """A block of the benchmark: word hashes of each item and its seeds, sorted."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    seed_item: np.ndarray
    min_match: int


def prepare(ids: list, texts: list[str | None], min_match: int = MIN_MATCH) -> Items:
    data, offsets = K.utf8(pa.array(texts, pa.string()))
    start, end, row = K.words(data, offsets)
    h = K.hashes(data, start, end)
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    keys, rows = _seeds(h, row, min_match)[:2]
    order = np.argsort(keys, kind="stable")
    return Items(ids, [h[first[i] : first[i + 1]] for i in range(len(ids))], keys[order], rows[order], min_match)


def _seeds(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place of the first word) of every run of k words of a row."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = K.mix(total + h[i : len(h) - k + 1 + i])
    at = np.flatnonzero(row[: len(total)] == row[k - 1 :])
    return total[at], row[at], at


def leaks_of(data: np.ndarray, offsets: np.ndarray, items: Items, coverage: float) -> list[tuple[int, int, float, list]]:
    """(row, item, share covered, tiles) for each leak in a slice of texts."""
    if not len(items.seeds):
        return []
    start, end, row = K.words(data, offsets)
    h = K.hashes(data, start, end)
    keys, rows, _ = _seeds(h, row, items.min_match)
    at = np.minimum(np.searchsorted(items.seeds, keys), len(items.seeds) - 1)
    hit = np.flatnonzero(items.seeds[at] == keys)
    first = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for r in np.unique(rows[hit]).tolist():
        mine = np.unique(keys[hit[np.searchsorted(rows[hit], r) : np.searchsorted(rows[hit], r + 1)]])
        low, high = np.searchsorted(items.seeds, mine, "left"), np.searchsorted(items.seeds, mine, "right")
        shared = defaultdict(int)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            for i in items.seed_item[a:b].tolist():
                shared[i] += 1
        doc = h[first[r] : first[r + 1]]
        for i, n in sorted(shared.items()):
            size = len(items.words[i])
            if min(size, n * items.min_match) < coverage * size:  # even apart from each other these seeds can't cover enough
                continue
            tiles = tile(doc, items.words[i], items.min_match)
            share = sum(t[2] for t in tiles) / size
            if share >= coverage:
                out.append((r, i, share, tiles))
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, min_match: int = MIN_MATCH):
    """The benchmark in broadcast-sized blocks; the number of blocks comes from a count of its bytes."""
    rows = benchmark.select(F.col("item_id"), F.col("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-n_bytes // (4 * block_words)))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if part:
            part.sort(key=lambda r: (r[0] is None, r[0], r[1] or ""))
            yield prepare([r[0] for r in part], [r[1] for r in part], min_match)


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row for each leaked (document, item): doc_id, item_id, the share of the item's words covered, and the tiles."""
    schema = "doc_id long, item_id long, coverage double, tiles array<struct<doc_word: long, item_word: long, words: long>>"
    kind = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
    out = None
    for items in blocks(benchmark, min_match=min_match):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            known = shared.value
            for b in K.slices(batches):
                found = leaks_of(*K.utf8(b.column("text")), known, coverage)
                if found:
                    ids = b.column("doc_id").take(pa.array([f[0] for f in found]))
                    tiles = [[dict(zip(("doc_word", "item_word", "words"), t, strict=True)) for t in f[3]] for f in found]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([known.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array(tiles, kind)], names=["doc_id", "item_id", "coverage", "tiles"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The documents without a leak, all their columns kept; each block filters what the one before left."""
    for items in blocks(benchmark, min_match=min_match):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for b in K.slices(batches):
                bad = [f[0] for f in leaks_of(*K.utf8(b.column("text")), shared.value, coverage)]
                keep = np.ones(b.num_rows, bool)
                keep[bad] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every benchmark item found in a document."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    return clean(docs, read(spark, sf_dir, "benchmark"))
