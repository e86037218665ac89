"""Scoring evidence: Fellegi-Sunter weights and posteriors, back-off confidence, ambiguity, acceptance policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postmark.functions.stats import rate, wilson_lower

#: Fixed values: (accept, suggest) posterior thresholds of each strictness.
THRESHOLDS = {"STRICT": (0.99, 0.8), "BALANCED": (0.95, 0.5), "LENIENT": (0.90, 0.3)}


def compare_postal(typed: Column, known: Column) -> Column:
    """exact, near (one digit differs), absent or mismatch."""
    differing = F.size(F.filter(F.sequence(F.lit(1), F.length(typed)), lambda i: F.substring(typed, i, F.lit(1)) != F.substring(known, i, F.lit(1))))
    return F.when(typed.isNull(), "absent").when(typed == known, "exact").when((F.length(typed) == F.length(known)) & (differing == 1), "near").otherwise("mismatch")


def compare_block(typed: Column, known: Column) -> Column:
    """exact, letter (same number, another letter), absent or mismatch."""
    bare = lambda c: F.regexp_replace(c, "[A-Z]+$", "")
    return F.when(typed.isNull(), "absent").when(typed == known, "exact").when(bare(typed) == bare(known), "letter").otherwise("mismatch")


def fit_weights(levels: DataFrame) -> DataFrame:
    """(field, level, weight): log2 of the smoothed ratio of level shares among true and false pairs; ``levels`` is (field, level, is_true)."""
    n = levels.groupBy("field", "level").agg(F.sum(F.col("is_true").cast("long")).alias("m"), F.sum((~F.col("is_true")).cast("long")).alias("u"))
    w = W.partitionBy("field")
    k, m, u = F.count("*").over(w), F.sum("m").over(w), F.sum("u").over(w)
    return n.select("field", "level", F.log2(((F.col("m") + 0.5) / (m + 0.5 * k)) / ((F.col("u") + 0.5) / (u + 0.5 * k))).alias("weight"))


def posterior(evidence: DataFrame, key: str, prior_none: float, temperature: float = 1.0) -> DataFrame:
    """Adds each candidate's posterior among its key's candidates and "none"; the evidence is in bits."""
    w = W.partitionBy(key)
    bits = (F.log2(F.lit(1 - prior_none) / F.count("*").over(w)) + F.col("evidence")) / temperature
    none = F.log2(F.lit(prior_none)) / temperature
    scored = evidence.withColumn("__b", bits)
    top = F.greatest(F.max("__b").over(w), none)
    total = F.sum(F.pow(F.lit(2.0), F.col("__b") - top)).over(w) + F.pow(F.lit(2.0), none - top)
    return scored.withColumn("posterior", F.pow(F.lit(2.0), F.col("__b") - top) / total).drop("__b")


def shrunk_confidence(rows: DataFrame, signatures: list[str], right: str, strength: float = 10.0) -> DataFrame:
    """Rows with a confidence that starts from the coarsest signature's rate and is pulled to each finer one's by its count.

    ``signatures`` go from finest to coarsest. Each signature takes one aggregation and one join.
    """
    counts = [rows.groupBy(s).agg(F.sum(F.col(right).cast("double")).alias(f"__c{k}"), F.count("*").alias(f"__n{k}")) for k, s in enumerate(signatures)]
    out = rows
    for s, c in zip(signatures, counts, strict=True):
        out = out.join(c, s, "left")
    last = len(signatures) - 1
    est = (F.coalesce(F.col(f"__c{last}"), F.lit(0)) + 1) / (F.coalesce(F.col(f"__n{last}"), F.lit(0)) + 2)
    for k in range(last - 1, -1, -1):
        c, n = F.coalesce(F.col(f"__c{k}"), F.lit(0)), F.coalesce(F.col(f"__n{k}"), F.lit(0))
        est = (c + strength * est) / (n + strength)
    return out.withColumn("confidence", est).drop(*(f"__{x}{k}" for k in range(last + 1) for x in "cn"))


def ambiguous(ranked: DataFrame, gap: float = 0.6, metres: float = 1000.0, key: str = "id") -> DataFrame:
    """(key, ambiguous): whether ranks 2 to 4 hold another street less than ``gap`` behind and more than ``metres`` away.

    ``ranked`` has key, street_id, score and metres (distance from the best).
    """
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "street_id"))
    first = F.struct(F.col("score"), F.col("street_id"))
    rows = ranked.withColumn("r", r).where("r <= 4").withColumn("best", F.first(first).over(W.partitionBy(key).orderBy("r")))
    close = (F.col("r") > 1) & (F.col("street_id") != F.col("best.street_id")) & (F.col("best.score") - F.col("score") < gap) & (F.col("metres") > metres)
    return rows.groupBy(key).agg(F.max(close).alias("ambiguous"))


def rival(top: Column, gap: float = 0.6, metres: float = 1000.0) -> Column:
    """``ambiguous`` of one list: its first four rows (street_id, score, metres) in order."""
    best = top[0]
    return F.exists(F.slice(top, 2, 3), lambda x: (x.street_id != best.street_id) & (best.score - x.score < gap) & (x.metres > metres))


def accept_policy(cases: DataFrame, n: int = 25, ok: float = 0.95, wilson: float = 0.88, gross: float = 0.02) -> DataFrame:
    """(market, key, n, ok, lower, gross) of the evidence keys good enough to accept; ``cases`` has market, key, ok and gross flags."""
    g = cases.groupBy("market", "key").agg(F.count("*").alias("n"), rate(F.col("ok")).alias("ok"), wilson_lower(F.sum(F.col("ok").cast("double")), F.count("*")).alias("lower"), rate(F.col("gross")).alias("gross"))
    return g.where((F.col("n") >= n) & (F.col("ok") >= ok) & (F.col("lower") >= wilson) & (F.col("gross") <= gross))


def decide(postal: Column, premise: Column, route: Column, unresolved: Column, strictness: str) -> Column:
    """ACCEPT or CONFIRM from component statuses (confirmed, corrected, inferred, replaced)."""
    any_of = lambda s: (postal == s) | (premise == s) | (route == s)
    doubt = any_of("replaced") | unresolved
    if strictness != "LENIENT":
        doubt = doubt | any_of("inferred") | any_of("corrected")
    return F.when(doubt, "CONFIRM").otherwise("ACCEPT")


def compare_street(found: Column, exact: Column, other_exact: Column) -> Column:
    """exact or corrected where the reading's street is the candidate's, other where it is another's exactly, else absent."""
    return F.when(found, F.when(exact, "exact").otherwise("corrected")).when(other_exact, "other").otherwise("absent")


def compare_building(rows: DataFrame, key: list[str], rest: str, buildings: str) -> DataFrame:
    """(key, building): absent without words left, match where a building's name has a token-set ratio of 90 or more with them, else nomatch."""
    from postmark.functions.similarity import token_set_ratio

    some = rows.select(*key, rest, F.explode_outer(buildings).alias("__b")).withColumn("__r", token_set_ratio(F.col("__b"), F.col(rest)))
    g = some.groupBy(*key).agg(F.max("__r").alias("__r"), F.first(rest).alias("__w"))
    return g.select(*key, F.when(F.coalesce("__w", F.lit("")) == "", "absent").when(F.coalesce(F.col("__r") >= 90, F.lit(False)), "match").otherwise("nomatch").alias("building"))


def pattern(*levels: Column) -> Column:
    return F.concat_ws("|", *levels)


def fit_patterns(rows: DataFrame, least: int = 5) -> DataFrame:
    """(pattern, weight): log2 of the smoothed ratio of a joint pattern's shares among true and false pairs; patterns of fewer than ``least`` rows have none."""
    n = rows.groupBy("pattern").agg(F.sum(F.col("is_true").cast("long")).alias("m"), F.sum((~F.col("is_true")).cast("long")).alias("u"))
    every = W.partitionBy(F.lit(1))  # as many rows as there are patterns
    m, u, k = F.sum("m").over(every), F.sum("u").over(every), F.count("*").over(every)
    w = F.log2(((F.col("m") + 0.5) / (m + 0.5 * k)) / ((F.col("u") + 0.5) / (u + 0.5 * k)))
    return n.withColumn("weight", w).where(F.col("m") + F.col("u") >= least).select("pattern", "weight")


def joint_evidence(rows: DataFrame, fields: list[str], weights: DataFrame, patterns: DataFrame, extra: str) -> DataFrame:
    """Adds ``evidence``: the weight of the joint pattern of ``fields`` where it has one, else the sum of theirs; and that of the field ``extra``."""
    out = rows.withColumn("pattern", pattern(*(F.col(f) for f in fields))).join(patterns.withColumnRenamed("weight", "__joint"), "pattern", "left")
    for f in [*fields, extra]:
        own = weights.where(F.col("field") == f).select(F.col("level").alias(f), F.col("weight").alias(f"__{f}"))
        out = out.join(own, f, "left")
    single = sum((F.coalesce(F.col(f"__{f}"), F.lit(0.0)) for f in fields), F.lit(0.0))
    return out.withColumn("evidence", F.coalesce("__joint", single) + F.coalesce(F.col(f"__{extra}"), F.lit(0.0))).drop("__joint", *(f"__{f}" for f in [*fields, extra]))


def confident(action: Column, confidence: Column, strictness: str) -> Column:
    """ACCEPT below the strictness's threshold becomes CONFIRM."""
    return F.when((action == "ACCEPT") & (confidence < THRESHOLDS[strictness][0]), "CONFIRM").otherwise(action)


def select_by_posterior(candidates: DataFrame, strictness: str) -> DataFrame:
    """(id, eid, action, confidence, reselected): the candidate (id, eid, posterior, rule_eid, rule_action) of the highest posterior.

    Below the lower threshold there is none: FIX. Another than the rule's is reselected; ACCEPT needs the upper threshold.
    """
    accept, some = THRESHOLDS[strictness]
    best = candidates.groupBy("id").agg(F.max_by(F.struct("eid", "posterior"), F.struct("posterior", -F.col("eid"))).alias("b"), F.first("rule_eid").alias("rule_eid"), F.first("rule_action").alias("rule_action"), F.sum("posterior").alias("all"))
    p = F.col("b.posterior")
    kept, own = p >= some, F.coalesce(F.col("b.eid") == F.col("rule_eid"), F.lit(False))
    action = F.when(~kept, "FIX").when(own, F.col("rule_action")).otherwise("CONFIRM")
    action = F.when((action == "ACCEPT") & (p < accept), "CONFIRM").otherwise(action)
    return best.select("id", F.when(kept, F.col("b.eid")).alias("eid"), action.alias("action"), F.when(kept, p).otherwise(1 - F.col("all")).alias("confidence"), (kept & ~own).alias("reselected"))


def save(weights: DataFrame, path: str) -> None:
    """Writes a model's table as JSON lines."""
    weights.write.mode("overwrite").json(path)


def load(weights: DataFrame | None, path: str, spark, schema: str = "field string, level string, weight double") -> DataFrame:
    """Reads a table of ``save``; ``weights`` are defaults below it, by field and level."""
    got = spark.read.schema(schema).json(path)
    return got if weights is None else got.unionByName(weights.join(got, ["field", "level"], "left_anti"))
