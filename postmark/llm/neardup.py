"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct runs of five words. Documents of equal sets form a class that
takes part once. Each of ``trees`` random trees starts with all classes in one node and branches
recursively: the path so far picks one coordinate of the minwise signature, and classes go to the
child of their minwise token there. After ``depth`` levels, a node of at most ``leaf`` classes and
``leaf_tokens`` tokens is compared exhaustively on full sets. A larger one branches on, now with
two picks a level so that a similar pair is likelier to stay together than not; what is
still large at ``max_depth`` is compared exhaustively too, in blocks against blocks. Nodes with
the same members are compared once. A comparison emits a spanning forest of its exact links.

A pair at similarity s shares a node of a tree with probability s ** depth at least, if no node
on its way is large. All trees pick from the same signature, so their misses aren't independent: at the defaults 0.75 is missed by all
with probability 0.0002, the mean of (1 - x ** 4) ** 28 over the share x of equal ones among 128 coordinates; a greater similarity far more seldom. A node of two members is dropped
unread where their one-bit sketches differ in more than ``APART`` places.

Null and empty texts have an empty set, are linked with nothing and stay. A text of fewer than five
words has its whole sequence as its one token. Rows that repeat a doc_id are one document for
linking; a null doc_id takes no part and stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .components import components
from .tables import read, release, shared_dir, store

WORDS, PERCENT = 5, 75
SIGNATURE, TREES, DEPTH, MAX_DEPTH = 128, 28, 4, 9
#: Two sets of similarity 0.75 differ in 16 of 128 one-bit minwise values by expectation; in more than this with probability under 1e-7.
APART = 37
LEAF, LEAF_TOKENS = 1600, 2_000_000
_A = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    n = len(offsets) - 1
    start, end, row = K.words(data, offsets, K.NONSPACE)
    keys, rows = K.shingles(K.hashes(data, start, end), row, n, k)
    cuts = np.searchsorted(rows, np.arange(n + 1))
    return [np.unique(keys[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def signatures(found: list[np.ndarray]) -> np.ndarray:
    """The minwise values of each set, 32 bits for each coordinate; zeros for an empty set."""
    out = np.zeros((len(found), SIGNATURE), np.uint32)
    full = [i for i, s in enumerate(found) if len(s)]
    if full:
        keys = np.concatenate([found[i] for i in full])
        starts = np.concatenate(([0], np.cumsum([len(found[i]) for i in full])[:-1]))
        for m, a in enumerate(_A):
            out[full, m] = np.minimum.reduceat((keys * a) >> np.uint64(32), starts)
    return out


def _names(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    one = np.array([int(K.mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in found], np.uint64)
    two = np.array([int(np.bitwise_xor.reduce(K.mix(s + np.uint64(0x1234567))) + np.uint64(len(s))) if len(s) else 0 for s in found], np.uint64)
    return one.view(np.int64), two.view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig) for every row; k1 and k2 name the set."""

    def run(batches):
        for b in K.slices(batches):
            found = sets(*K.utf8(b.column("text")))
            sig = signatures(found)
            k1, k2 = _names(found)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, SIGNATURE), pa.int32()), pa.array(sig.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array([len(s) for s in found], np.int64)), pa.array(k1), pa.array(k2), flat], names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>")


def _child(node, picks: str):
    """The node reached from ``node`` by the coordinate that it picks itself."""
    at = F.pmod(F.xxhash64(node, F.lit(picks)), F.lit(SIGNATURE)).cast("int")
    return F.xxhash64(node, at, F.get("sig", at))


def roots(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(node, id, n, s0, s1) after the first ``depth`` levels of every tree: the choice needs nothing but the class's own signature."""
    bits = [F.aggregate(F.slice("sig", 1 + 64 * k, 64), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x.bitwiseAND(1).cast("long"))) for k in (0, 1)]
    rows = classes.select("id", "n", "sig", *(b.alias(f"s{k}") for k, b in enumerate(bits)), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(trees).cast("long"))).alias("tree"))
    node = F.xxhash64("tree")
    for level in range(depth):
        rows = rows.withColumn(f"n{level}", _child(node, "first"))
        node = F.col(f"n{level}")
    return rows.select(node.alias("node"), "id", "n", "s0", "s1")


def _sized(rows: DataFrame) -> DataFrame:
    """Each node of two members or more with its size, tokens and a digest of its members."""
    return rows.groupBy("node").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"), F.bit_xor(F.xxhash64("id")).alias("who"), (F.bit_count(F.bit_xor("s0")) + F.bit_count(F.bit_xor("s1"))).alias("apart")).where(
        f"members > 1 and (members > 2 or apart <= {APART})"
    )


def nodes(classes: DataFrame, folder: str, trees: int, depth: int, max_depth: int, leaf: int, leaf_tokens: int) -> DataFrame:
    """(node, id, left, right): members of the nodes to compare. left and right number blocks; both 0 in a node of one block."""
    rows, out = roots(classes, trees, depth), []
    small = (F.col("members") <= leaf) & (F.col("tokens") <= leaf_tokens)
    for level in range(depth, max_depth + 1):
        sized = store(_sized(rows), folder, f"nodes-{level}")
        leaves = sized.where(small).groupBy("who", "members", "tokens").agg(F.min("node").alias("node")).select("node")
        out.append(rows.join(leaves, "node").select("node", "id", F.lit(0).alias("left"), F.lit(0).alias("right")))
        large = sized.where(~small)
        if large.isEmpty():
            break
        big = rows.join(large, "node")
        if level == max_depth:
            # each pair of blocks is one comparison, so that no task holds a node of unbounded size
            blocks = F.greatest(F.ceil(F.col("members") / (leaf // 2)), F.ceil(F.col("tokens") / (leaf_tokens // 2))).cast("int")
            own = big.select("node", "id", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            out.append(spread.select("node", "id", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right")))
        else:
            deeper = big.select("node", "id", "n", "s0", "s1").join(classes.select("id", "sig"), "id").withColumn("pick", F.explode(F.array(F.lit("a"), F.lit("b"))))
            at = F.pmod(F.xxhash64("node", "pick"), F.lit(SIGNATURE)).cast("int")
            rows = store(deeper.select(F.xxhash64("node", "pick", F.get("sig", at)).alias("node"), "id", "n", "s0", "s1"), folder, f"rows-{level}")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def linked(found: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links of a node: every pair that isn't joined already is held against the exact threshold."""
    n = len(found)
    size = np.array([len(s) for s in found], np.int64)
    label = np.arange(n)
    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = label[i], label[j]
        if a != b:
            out.append((i, j))
            label[label == max(a, b)] = min(a, b)

    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                low, high = sorted((int(size[i]), int(size[j])))
                if low and label[i] != label[j] and 100 * low >= percent * high:
                    both = len(np.intersect1d(found[i], found[j], assume_unique=True))
                    if 100 * both >= percent * (low + high - both):
                        join(i, j)
        return out
    keys = np.concatenate(found)
    rows = np.repeat(np.arange(n), size)
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    ok = shared[inverse]
    rows, cols = rows[ok], column[inverse[ok]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    both = np.zeros((n, n), np.float32)
    width, total = 4096, int(shared.sum())
    for begin in range(0, total, width):
        a, b = np.searchsorted(cols, [begin, begin + width])
        m = np.zeros((n, min(width, total - begin)), np.float32)
        m[rows[a:b], cols[a:b] - begin] = 1
        both += m @ m.T
    inter = np.rint(both).astype(np.int64)
    close = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    np.fill_diagonal(close, False)
    close &= (size > 0)[:, None] & (size > 0)[None, :]
    seen = np.zeros(n, bool)
    for i in range(n):
        if not seen[i]:
            seen[i] = True
            todo = [i]
            while todo:
                k = todo.pop()
                fresh = np.flatnonzero(close[k] & ~seen)
                seen[fresh] = True
                todo += fresh.tolist()
                out += [(k, j) for j in fresh.tolist()]
    return out


def _compare(batches):
    """Links (a, b) within each run of rows of one comparison; rows come sorted by it."""

    def emit(ids: list, members: list[np.ndarray]):
        pairs = linked(members)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], names=["a", "b"])

    now, ids, members = None, [], []
    for b in batches:
        keys = list(zip(b.column("node").to_pylist(), b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True))
        for key, one, raw in zip(keys, b.column("id").to_pylist(), b.column("tokens"), strict=True):
            if key != now:
                yield from emit(ids, members)
                now, ids, members = key, [], []
            ids.append(one)
            members.append(np.frombuffer(raw.as_buffer(), np.uint64))
    yield from emit(ids, members)


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, tokens) for the classes in ``wanted`` (id, k1, k2): the full set as packed 64-bit hashes."""

    def run(batches):
        for b in K.slices(batches):
            found = sets(*K.utf8(b.column("text")))
            k1, k2 = _names(found)
            keep = (k1 == b.column("k1").to_numpy()) & (k2 == b.column("k2").to_numpy())
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array([found[i].tobytes() for i in at], pa.binary())], names=["id", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id")
    return rows.mapInArrow(run, "id long, tokens binary")


def links(docs: DataFrame, classes: DataFrame, folder: str, trees: int = TREES, depth: int = DEPTH, max_depth: int = MAX_DEPTH, leaf: int = LEAF, leaf_tokens: int = LEAF_TOKENS) -> DataFrame:
    """Links (a, b) between class representatives: a spanning forest for each node compared."""
    release(docs.sparkSession)
    members = store(nodes(classes, folder, trees, depth, max_depth, leaf, leaf_tokens), folder, "members")
    release(docs.sparkSession)
    active = members.select("id").distinct()
    full = store(token_sets(docs, classes.select("id", "k1", "k2").join(active, "id")), folder, "tokens")
    release(docs.sparkSession)
    rows = members.join(full, "id").repartition("node", "left", "right").sortWithinPartitions("node", "left", "right")
    return store(rows.select("node", "left", "right", "id", "tokens").mapInArrow(_compare, "a long, b long").distinct(), folder, "links")


def near_duplicates(docs: DataFrame, folder: str | None = None, **tree: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    rows = store(described(docs), folder, "described")
    named = rows.where("doc_id is not null and n_shingles > 0")
    # equal sets have equal signatures, so any of them stands for the class
    classes = store(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig")), folder, "classes")
    found = links(docs, classes, folder, **tree)
    # rows that repeat a doc_id with other texts join their classes
    names = named.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "id"), ["k1", "k2"]).select("doc_id", "id")
    twice = names.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")
    found = found.unionByName(twice)
    release(spark)
    of = components(found, folder)
    release(spark)
    member = names.join(of, "id", "left").select("doc_id", F.least("doc_id", F.coalesce("component", "id")).alias("c")).groupBy("doc_id").agg(F.min("c").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(member, "doc_id", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the near-duplicate component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one of least doc_id; a null doc_id stays."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS k FROM w),
x AS (SELECT doc_id, len(k) AS n, unnest(k) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x AS a JOIN x AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
e AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT doc_id AS u, doc_id AS r FROM s UNION SELECT e.v, c.r FROM c JOIN e USING (u)),
m AS (SELECT u AS doc_id, min(r) AS component_id FROM c GROUP BY u)
SELECT doc_id, len(k)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)"""
