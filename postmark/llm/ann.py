"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are lifted to one norm for hashing: the greatest norm M among all rows, with sqrt(M^2 - |v|^2) as one more
coordinate, and queries are scaled to M with 0 there, so that the largest inner product is the least distance whatever the norms are.

Each of ``TABLES`` tables hashes a vector by ``k`` random projections cut into cells of one width. A query
visits its own bucket and perturbed ones (each cell index moved by -1, 0 or 1) in order of estimated
success: the sum of squared distances from its projections to the borders crossed. The number
of probes is the least that finds ``target`` of the true neighbours on a bounded sample
(``SAMPLE`` vectors by least hash), where neighbours are farther than among all rows. Of several cell widths and numbers of projections,
those are taken that reach the target with the least share of the sample's rows looked at; where none does within ``PROBES``
probes, there are no projections: one bucket, an exhaustive search by the same path. A query for which the probes find
fewer than asked for visits every bucket of the first table, which holds every row. All
rows are indexed; candidates of all tables are merged and ranked by exact inner product.

A bucket of more than ``CELL`` vectors is split into cells by hash of vec_id, and a query visits them all, so
no task holds an unbounded bucket; vectors and queries meet in groups of bounded size, and a vector goes only to the blocks of
queries that visit its bucket. The number of projections grows with the logarithm of the count of rows, without a bound.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, neither do null ids. Candidates that carry the query's own id are its own row. Ties go
to the smaller vec_id; a candidate id that repeats counts once, with its best score. A query id that repeats is searched by its least vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernel as K
from .tables import read, shared_dir, store

TABLES = 2
#: Cell widths tried, as parts of the norm; probes a query and table at most, which bounds the work of finding them.
WIDTHS, PROBES = (0.5, 1.0, 2.0), 2187
SAMPLE, SAMPLE_QUERIES, TARGET = 8000, 300, 0.95
BUCKET, CELL, GROUP, QUERIES = 512, 4096, 40_000, 10_000


@dataclass
class Hashing:
    """The projections (tables, k, dimensions and the lifted one), offsets, the cell width and the norm that vectors are lifted to."""

    a: np.ndarray
    b: np.ndarray
    width: float
    norm: float
    probes: int = 1

    @property
    def k(self) -> int:
        return self.a.shape[1]

    def places(self, v: np.ndarray, asked: bool = False) -> np.ndarray:
        """(rows, tables, k) positions in units of the width, of vectors or of queries (``asked``)."""
        v = v.astype(np.float64)
        square = (v**2).sum(1)
        if asked:
            v, lift = v * (self.norm / np.sqrt(square))[:, None], np.zeros(len(v))
        else:
            lift = np.sqrt(np.maximum(self.norm**2 - square, 0))
        return (np.einsum("nd,tkd->ntk", v, self.a[..., :-1]) + lift[:, None, None] * self.a[..., -1] + self.b) / self.width

    def names(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit name for each (…, k) vector of cell indices."""
        h = np.zeros(cells.shape[:-1], np.uint64)
        for j in range(cells.shape[-1]):
            h = K.mix(h + cells[..., j].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return h.view(np.int64)

    def visits(self, v: np.ndarray, probes: int) -> np.ndarray:
        """(rows, tables, probes) bucket names in order of estimated success."""
        place = self.places(v, asked=True)
        cell = np.floor(place).astype(np.int64)
        x = place - cell
        # sums grow coordinate by coordinate; a prefix that isn't among the best so far can't be among the best in the end
        cost = np.zeros((*x.shape[:2], 1))
        moves = np.zeros((*x.shape[:2], 1, 0), np.int8)
        for j in range(self.k):
            each = np.stack((np.zeros(x.shape[:2]), x[..., j] ** 2, (1 - x[..., j]) ** 2), axis=-1)
            n = cost.shape[-1]
            cost = (cost[..., :, None] + each[..., None, :]).reshape(*x.shape[:2], -1)
            steps = np.broadcast_to(np.tile(np.array([0, -1, 1], np.int8), n)[:, None], (*x.shape[:2], 3 * n, 1))
            moves = np.concatenate((np.repeat(moves, 3, axis=2), steps), axis=3)
            if cost.shape[-1] > probes:
                best = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
                cost, moves = np.take_along_axis(cost, best, -1), np.take_along_axis(moves, best[..., None], 2)
        order = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
        return self.names(cell[:, :, None, :] + np.take_along_axis(moves, order[..., None], 2))


def _valid(rows: DataFrame, dimensions: int) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == dimensions) & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def measured(v: np.ndarray, norm: float, k: int, k_near: int, target: float, seed: int = 3, widths: tuple[float, ...] = WIDTHS) -> Hashing:
    """Of at most ``k`` projections and the widths (of the norm), those by which ``target`` of the true neighbours within ``v`` are found by the least rows looked at, and the least number of probes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.normal(size=(TABLES, k, v.shape[1] + 1)), rng.uniform(0, 1, (TABLES, k))
    queries = v[:SAMPLE_QUERIES]
    score = queries @ v.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k_near, len(v) - 1)] if len(v) > 1 else np.zeros((0, 0), int)
    none = Hashing(a[:1, :0], b[:1, :0], norm, norm)  # one bucket; one table is all
    if not near.size:
        return none
    found, least = none, 1.0
    for width in (w * norm for w in widths):
        for n in range(k, 0, -1):
            h = Hashing(a[:, :n], b[:, :n] * width, width, norm)
            own = h.names(np.floor(h.places(v)).astype(np.int64))
            h.probes = min(3**n, PROBES)
            visits = h.visits(queries, h.probes)
            rank, seen = np.full(near.shape, h.probes), np.zeros((len(queries), h.probes))
            for t in range(TABLES):
                names, sizes = np.unique(own[:, t], return_counts=True)
                for q in range(len(queries)):
                    order = np.argsort(visits[q, t], kind="stable")
                    at = np.minimum(np.searchsorted(visits[q, t], own[near[q], t], sorter=order), h.probes - 1)
                    hit = visits[q, t][order[at]] == own[near[q], t]
                    rank[q] = np.where(hit, np.minimum(rank[q], order[at]), rank[q])
                    at = np.minimum(np.searchsorted(names, visits[q, t]), len(names) - 1)
                    seen[q] += np.where(names[at] == visits[q, t], sizes[at], 0)
            needed = int(np.quantile(rank.ravel(), target, method="higher")) + 1
            if needed > h.probes:
                continue  # out of reach
            h.probes = needed
            share = float(np.minimum(seen[:, :needed].sum(1) / len(v), 1).mean())
            if share < least:
                found, least = h, share
    return found


def fit(rows: DataFrame, count: int, norm: float, dimensions: int, k_near: int, target: float = TARGET, seed: int = 3) -> Hashing:
    """Projections for ``count`` vectors of norms up to ``norm``, and the number of probes measured on the sample."""
    k = max(1, int(np.ceil(np.log2(max(count, 1) / BUCKET) / 1.8)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "embedding").toArrow()
    v = _matrix(sample.column("embedding"), dimensions).astype(np.float64) if sample.num_rows else np.zeros((0, dimensions))
    return measured(v, norm, k, k_near, target, seed)


def _best(query: np.ndarray, query_id: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query, vector, score) indices of the k best of ``vectors`` for each query, ties to smaller ids, own ids left out."""
    for begin in range(0, len(query), 64):
        q = query[begin : begin + 64]
        s = q @ vectors.T
        s[query_id[begin : begin + 64, None] == ids[None, :]] = -np.inf
        if s.shape[1] > k:
            border = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(border), border, 0)))
            rows, cols = np.nonzero((s >= (border - slack)[:, None]) & (s > -np.inf))
        else:
            rows, cols = np.nonzero(s > -np.inf)
        exact = np.empty(len(rows))
        for a in range(0, len(rows), 100_000):  # the same sum for every pair, whatever block it came from
            exact[a : a + 100_000] = (q[rows[a : a + 100_000]] * vectors[cols[a : a + 100_000]]).sum(1)
        order = np.lexsort((ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < k
        yield begin + rows[keep], cols[keep], exact[keep]


def search(rows: DataFrame, is_query, k_near: int = 20, target: float = TARGET, folder: str | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest found; ``is_query`` is a Column on vec_id."""
    spark = rows.sparkSession
    folder = folder or shared_dir(spark)
    schema = "query_id long, vec_id long, score double"
    sizes = rows.where("embedding is not null and vec_id is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None or not sizes["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = sizes["n"]
    rows = _valid(rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), d)
    count, square = rows.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    shared = spark.sparkContext.broadcast(fit(rows, count, float(np.sqrt(square or 1.0)), d, k_near, target))
    tables, probes = shared.value.a.shape[0], shared.value.probes

    def placed(batches):
        h = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            name = h.names(np.floor(h.places(_matrix(b.column("embedding"), d))).astype(np.int64))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(name[:, t]), b.column("vec_id"), b.column("embedding")], names=["t", "bucket", "vec_id", "embedding"])

    def visited(batches):
        h = shared.value
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                part = b.slice(begin, 256)
                name = h.visits(_matrix(part.column("embedding"), d), probes)
                n, _, p = name.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("vec_id").to_numpy(), tables * p)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), p), n)), pa.array(name.ravel())], names=["query_id", "t", "bucket"])

    index = store(rows.mapInArrow(placed, "t int, bucket long, vec_id long, embedding array<double>"), folder, "index")
    buckets = index.groupBy("t", "bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    groups, blocks = max(1, -(-count * tables // GROUP)), max(1, -(-queries.count() // QUERIES))
    group = F.pmod(F.xxhash64("t", "bucket", "cell"), F.lit(groups)).cast("int").alias("g")
    name = F.xxhash64("t", "bucket", "cell").alias("place")
    cell = F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int")
    vectors = index.join(buckets, ["t", "bucket"]).withColumn("cell", cell).select(group, name, "vec_id", "embedding")
    own = queries.select(F.col("vec_id").alias("query_id"), "embedding")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        query, query_id = _matrix(left.column("embedding"), d), left.column("query_id").to_numpy()
        places = left.column("places").combine_chunks()
        who, where = np.repeat(np.arange(left.num_rows), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy()
        order = np.lexsort((who, where))
        who, where = who[order], where[order]
        vec, ids, at = _matrix(right.column("embedding"), d), right.column("vec_id").to_numpy(), right.column("place").to_numpy()
        order = np.lexsort((ids, at))
        vec, ids, at = vec[order], ids[order], at[order]
        kept_q, kept_v, kept_s = [], [], []
        for p in np.unique(at).tolist():
            a, b = np.searchsorted(at, [p, p + 1]) if p < np.iinfo(np.int64).max else (np.searchsorted(at, p), len(at))
            i, j = np.searchsorted(where, p, "left"), np.searchsorted(where, p, "right")
            mine = who[i:j]
            if len(mine):
                for q, v, s in _best(query[mine], query_id[mine], vec[a:b], ids[a:b], k_near):
                    kept_q.append(query_id[mine[q]])
                    kept_v.append(ids[a + v])
                    kept_s.append(s)
        if not kept_q:
            return none
        q, v, s = np.concatenate(kept_q), np.concatenate(kept_v), np.concatenate(kept_s)
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])))  # the same vector through two tables
        q, v, s = q[new], v[new], s[new]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k_near
        return pa.table({"query_id": q[keep], "vec_id": v[keep], "score": s[keep]})

    def best(probe: DataFrame) -> DataFrame:
        """The k_near best of each query among the buckets that ``probe`` (query_id, t, bucket, cells) visits."""
        probe = probe.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select("query_id", group, name)
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
        asked = probe.groupBy("query_id", "g").agg(F.collect_set("place").alias("places")).join(own, "query_id").withColumn("block", block)
        wanted = probe.select("g", "place", block).distinct()  # a vector goes to the blocks that ask for its place
        sent = vectors.join(wanted, ["g", "place"])
        found = asked.groupBy("g", "block").cogroup(sent.groupBy("g", "block")).applyInArrow(meet, schema)
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k_near).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

    # a probe of an empty bucket ends here
    found = best(queries.mapInArrow(visited, "query_id long, t int, bucket long").join(buckets, ["t", "bucket"]))
    if tables == 1:
        return found
    found = store(found, folder, "found")
    full = found.groupBy("query_id").count().where(F.col("count") >= k_near)
    short = store(own.select("query_id").join(full, "query_id", "left_anti"), folder, "short")
    if short.isEmpty():
        return found
    rest = best(short.crossJoin(buckets.where("t = 0")))
    return found.join(short, "query_id", "left_anti").unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the 20 nearest of every vector whose id is divisible by 20, among all others."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
