"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line's set is its distinct words (lower case, cut at spaces; white space at the line's ends doesn't count). Words are ordered by
rarity: all words of all texts are counted in ``2 ** RANK_BITS`` buckets of their hash, and the magnitude of its bucket's count is what a word sorts by, then
its hash. So the driver gathers the same few counts whatever the vocabulary, and a word's place is one look-up. Any two
lines with Jaccard similarity of ``percent`` / 100 or more share a word among the first
n - ceil(percent * n / 100) + 1 of this order (prefix filter); the length filter and the
positional filter at the shared word prune pairs, and so does a bitmap filter (64 parity bits of the
set, which can't differ in more places than the sets in words), before their words are compared in full. A
line goes if an earlier line (by doc_id, then place in the text) is similar to it, whether or
not that line goes itself.

Equal lines are one entry of the join. To keep groups of many variants linear, entries are first held against the earliest entry
under each shared prefix word; only those that match none of these are joined with all.

Lines without words stay. A null text stays null; a text whose lines all go becomes empty.
Null doc_ids come after all others. In rows that repeat a doc_id, lines are ordered by their place,
then by a hash of the text; similar lines at the same place of such rows aren't earlier than each other, and
wholly equal rows stand or fall together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import drop, read, release, shared_dir, store

PERCENT = 85
#: Word counts are kept for 2 ** RANK_BITS buckets of the hash; this bounds what the driver gathers and each task holds.
RANK_BITS = 16
#: Steps of a count's magnitude for each doubling; they fit into so many bits up to 2 ** 42 words. Every plan prints all ranks, so they are kept short.
STEPS, STEP_BITS = 3, 7
_LAST = (1 << 63) - 1


def _trimmed(line):
    """The line without white space at its ends; the costly trim runs only where there is some."""
    odd = F.lit(False)
    for c in " \t\r":
        odd = odd | line.startswith(c) | line.endswith(c)
    return F.when(odd, F.btrim(line, F.lit(" \t\r"))).otherwise(line)


def _codes(line):
    return F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))


def _rows(docs: DataFrame) -> DataFrame:
    """(d, r, line_no, line): every line that isn't blank, normalised, with its document's key."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    lines = docs.where("text is not null").select(key.alias("d"), F.xxhash64("text").alias("r"), F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    return lines.select("d", "r", "line_no", _trimmed(F.col("line")).alias("line")).where("line <> ''")


def _bucket(hashed):
    return hashed.bitwiseAND((1 << RANK_BITS) - 1)


def ranks(docs: DataFrame):
    """An array Column: for each bucket of word hashes the magnitude of its count over all texts (0 for none), in ``STEPS`` to the doubling."""
    words = docs.select(F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = {r["b"]: r["n"] for r in words.select(_bucket(F.xxhash64("w")).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
    said = ",".join(str(min(int(STEPS * math.log2(1 + counts.get(b, 0))), (1 << STEP_BITS) - 1)) for b in range(1 << RANK_BITS))
    return F.split(F.lit(said), ",").cast("array<bigint>")  # folded to one literal when the plan is made


def _ordered(line, ranked):
    """The distinct words as longs that sort by rarity: the magnitude of the bucket's count, then as many bits of the hash as are left."""

    def key(h):
        rank = F.coalesce(F.get(ranked, _bucket(h).cast("int")), F.lit(0).cast("long"))  # never null, and longs without nulls are sorted unboxed
        return F.shiftleft(rank, 63 - STEP_BITS).bitwiseOR(F.shiftrightunsigned(h, STEP_BITS + 1))

    return F.sort_array(F.transform(_codes(line), key))


def _name():
    return F.xxhash64("line").alias("k1"), F.hash("line").alias("k2")


def entries(docs: DataFrame, ranked, percent: int) -> DataFrame:
    """One row a distinct line: its name (k1, k2), first place f, times said, n words, parity s, and its prefixes.

    ``prefix`` is what a line shows to lines that aren't longer; of it the first ``short`` words are enough towards lines that aren't shorter.
    """
    rows = _rows(docs).select("d", "r", "line_no", *_name(), _ordered("line", ranked).alias("codes"))
    parity = F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))))
    n = F.size("codes")
    prefix = F.slice("codes", F.lit(1), n - F.ceil(n * percent / F.lit(100)).cast("int") + 1)
    # the name settles n, s and the prefix, which are cheaper to group by than to carry along
    rows = rows.select("d", "r", "line_no", "k1", "k2", parity.alias("s"), n.alias("n"), prefix.alias("prefix"))
    sets = rows.groupBy("k1", "k2", "n", "s", "prefix").agg(F.min(F.struct("d", "line_no", "r")).alias("f"), F.count("*").alias("times"))
    short = F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent)).cast("int") + 1
    return sets.withColumn("short", short)


def _near(percent: int):
    """Length, positional and bitmap filters for entries that share the word at places i of x and y."""
    xn, xi, yn, yi = (F.col(c) for c in ("xn", "xi", "yn", "yi"))
    most = 1 + F.least(xn - xi - 1, yn - yi - 1)
    apart = F.bit_count(F.col("xs").bitwiseXOR(F.col("ys")))
    # overlap is at most half of what the words that differ leave of both
    alike = F.least(xn, yn) * 100 >= F.greatest(xn, yn) * percent
    return alike & (most * (100 + percent) >= (xn + yn) * percent) & ((xn + yn - apart) * (100 + percent) >= 2 * (xn + yn) * percent)


_PAIR = ("yd", "yl", "xd", "xl")


def _similar(docs: DataFrame, pairs: DataFrame, folder: str, name: str, percent: int) -> DataFrame:
    """(k1, k2) of the later lines of pairs that are similar on their whole sets."""
    ends = pairs.select(F.col("yd").alias("d"), F.col("yl").alias("l")).unionByName(pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")))
    wanted = ends.groupBy("d").agg(F.collect_set("l").alias("wanted"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    found = docs.where("text is not null").select(key.alias("d"), "text").join(wanted.hint("shuffle_hash"), "d").select("d", "wanted", F.posexplode(F.split(F.lower("text"), "\n")).alias("l", "line"))
    found = found.where(F.array_contains("wanted", F.col("l"))).select("d", "l", _trimmed(F.col("line")).alias("line")).where("line <> ''")
    full = store(found.select("d", "l", *_name(), _codes("line").alias("codes")).distinct(), folder, f"{name}-codes")
    release(docs.sparkSession)
    x = full.select(F.col("d").alias("xd"), F.col("l").alias("xl"), F.col("codes").alias("xc"))
    y = full.select(F.col("d").alias("yd"), F.col("l").alias("yl"), "k1", "k2", F.col("codes").alias("yc"))
    both = F.size(F.array_intersect("xc", "yc"))
    ok = both * (100 + percent) >= (F.size("xc") + F.size("yc")) * percent
    out = store(pairs.join(x, ["xd", "xl"]).join(y, ["yd", "yl"]).where(ok).select("k1", "k2").distinct(), folder, f"{name}-gone")
    drop(docs.sparkSession, f"{folder}/{name}-codes")
    release(docs.sparkSession)
    return out


def _class(n):
    return F.length(F.bin(n))


def _shown(sets: DataFrame, side: str, short: bool, also=None) -> DataFrame:
    """One row for each word of the prefix, or of its short part, with the columns of a side of the join.

    Its key is the word together with the size class of the line, and again with that of the size ``also`` where it is another.
    """
    words = F.expr("slice(prefix, 1, short)") if short else F.col("prefix")
    rows = sets.select(F.col("f.d").alias(f"{side}d"), F.col("f.line_no").alias(f"{side}l"), F.col("n").alias(f"{side}n"), F.col("s").alias(f"{side}s"), F.posexplode(words).alias(f"{side}i", "w"))
    n = F.col(f"{side}n")
    size = _class(n) if also is None else F.explode(F.array_distinct(F.array(_class(n), _class(also))))
    return rows.withColumn("size", size).withColumn("w", F.xxhash64("w", "size")).drop("size")


def _matches(longer: DataFrame, shorter: DataFrame, percent: int, few: bool) -> DataFrame:
    """Pairs (y later, x earlier) of a line of ``longer`` and one of ``shorter`` that is no longer and may be similar; with ``few``, the longer are few."""
    least, most = F.ceil(F.col("yn") * percent / F.lit(100)), F.floor(F.col("xn") * 100 / F.lit(percent))
    y, x = _shown(longer, "y", short=False, also=least if few else None), _shown(shorter, "x", short=True, also=None if few else most)
    below = F.struct("xd", "xl") < F.struct("yd", "yl")
    ordered = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & below)
    pairs = y.join(x, "w").where(ordered & _near(percent))
    swap = lambda a, b: F.when(below, F.col(a)).otherwise(F.col(b))
    return pairs.select(swap("yd", "xd").alias("yd"), swap("yl", "xl").alias("yl"), swap("xd", "yd").alias("xd"), swap("xl", "yl").alias("xl"))


def removed_lines(docs: DataFrame, folder: str, percent: int = PERCENT) -> DataFrame:
    """(d, r, gone): for each document that loses lines, their numbers from 0."""
    spark = docs.sparkSession
    sets = store(entries(docs, ranks(docs), percent), folder, "sets")
    release(spark)
    least = F.min(F.struct(*(F.col(f"y{c}").alias(f"x{c}") for c in ("d", "l", "n", "s", "i")))).over(W.partitionBy("w"))
    first = _shown(sets, "y", short=True).withColumn("x", least).select("yd", "yl", "yn", "ys", "yi", "x.*")
    first = first.where((F.struct("xd", "xl") < F.struct("yd", "yl")) & _near(percent)).select(*_PAIR).distinct()
    first = store(first, folder, "first")
    release(spark)
    gone = _similar(docs, first, folder, "first", percent)
    marked = store(sets.join(gone.withColumn("done", F.lit(True)), ["k1", "k2"], "left"), folder, "marked")
    drop(spark, f"{folder}/sets")
    release(spark)
    rest, done = marked.where("done is null"), marked.where("done")
    # what is gone already may still be the earlier line of a pair
    second = []
    for part, (longer, shorter, few) in {"second-a": (rest, marked, False), "second-b": (done, rest, True)}.items():
        second.append(store(_matches(longer, shorter, percent, few).distinct(), folder, part))
        release(spark)
    pairs = second[0].unionByName(second[1]).distinct().join(first, list(_PAIR), "left_anti")
    bad = gone.unionByName(_similar(docs, store(pairs, folder, "pairs"), folder, "second", percent)).distinct()
    verdict = marked.select("k1", "k2", "f", "times").join(bad.withColumn("bad", F.lit(True)), ["k1", "k2"], "left").where("bad or times > 1")
    lost = _rows(docs).select("d", "r", "line_no", *_name()).join(verdict.hint("shuffle_hash"), ["k1", "k2"]).where((F.struct("d", "line_no", "r") != F.col("f")) | F.col("bad"))
    lost = store(lost.groupBy("d", "r").agg(F.collect_set("line_no").alias("gone")), folder, "lost")
    for name in ("marked", "first", "second-a", "second-b", "pairs", "first-gone", "second-gone"):
        drop(spark, f"{folder}/{name}")
    release(spark)
    return lost


def dedup_lines(docs: DataFrame, percent: int = PERCENT, folder: str | None = None, report: bool = True) -> DataFrame:
    """Every row with its columns, later similar lines taken out of text; with ``report``, n_lines and n_removed beside them (in place of any of that name)."""
    folder = folder or shared_dir(docs.sparkSession)
    lost = removed_lines(docs, folder, percent)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("d"), F.xxhash64("text").alias("r")).join(lost.hint("shuffle_hash"), ["d", "r"], "left")
    lines = F.split("row.text", "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    counts = {
        "n_lines": F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
    }
    kept = [(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if not (report and c in counts)]
    return rows.select(*kept, *(v.alias(k) for k, v in counts.items() if report))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document with what is left of its text."""
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same documents with later similar lines taken out; n_chars follows the text."""
    out = dedup_lines(docs, report=False)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
s AS (SELECT doc_id, line, line_no, list_sort(list_distinct(list_filter(string_split(trim(lower(line), ' ' || chr(9) || chr(13)), ' '), lambda w: trim(lower(line), ' ' || chr(9) || chr(13)) <> ''))) AS words FROM l),
d AS (SELECT words, len(words) AS n, min((doc_id, line_no)) AS f FROM s WHERE len(words) > 0 GROUP BY words),
t AS (SELECT f, n, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
c AS (SELECT w, count(*) AS c FROM t GROUP BY w),
o AS (SELECT f, n, w, row_number() OVER (PARTITION BY f ORDER BY c, w) AS i FROM t JOIN c USING (w)),
p AS (SELECT * FROM o WHERE i <= n - ceil(n * {PERCENT} / 100.0) + 1),
q AS (SELECT DISTINCT y.f AS yf, x.f AS xf FROM p AS y JOIN p AS x ON x.w = y.w AND x.f < y.f AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * {PERCENT}),
g AS (SELECT DISTINCT yf AS f FROM q JOIN d AS y ON y.f = q.yf JOIN d AS x ON x.f = q.xf
  WHERE len(list_intersect(x.words, y.words)) * {100 + PERCENT} >= (x.n + y.n) * {PERCENT}),
v AS (SELECT s.doc_id, s.line_no, s.line, len(s.words) > 0 AND ((s.doc_id, s.line_no) <> d.f OR g.f IS NOT NULL) AS gone
  FROM s LEFT JOIN d ON d.words = s.words LEFT JOIN g ON g.f = d.f),
r AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT coalesce(gone, false)), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM v GROUP BY doc_id)
SELECT documents.doc_id, r.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed FROM documents LEFT JOIN r USING (doc_id)"""
