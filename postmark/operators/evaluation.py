"""Evaluating results against truth: outcomes, rates, distances, parity, failure buckets. Every summary is conditional aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres within which a result of each granularity is right.
NEAR = {"PREMISE": 250, "PREMISE_PROXIMITY": 400, "ROUTE": 250, "LOCALITY": 3000}
PASSED = ("ACCEPT", "CONFIRM_ADD_SUBPREMISES")


def share(part: Column, of: Column) -> Column:
    """The share of the rows of ``of`` in which ``part`` holds; 0 where there are none."""
    n = F.sum(F.coalesce(of, F.lit(False)).cast("long"))
    return F.when(n > 0, F.sum(F.coalesce(of & part, F.lit(False)).cast("long")) / n).otherwise(0.0)


def golden_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates of (expected, expected_id, action, found_id): all right, action right, false accepts, found misfits, false rejects, needless confirmations, right addresses, silent errors."""
    e, a = F.col("expected"), F.col("action")
    same, every = F.coalesce(F.col("found_id") == F.col("expected_id"), F.lit(False)), F.lit(True)
    bad = e == "FIX"
    out = {
        "full_correct": share((a == e) & (bad | same), every), "action_right": share(a == e, every), "false_accept": share(a == "ACCEPT", bad), "fix_recall": share(a == "FIX", bad), "false_reject": share(a == "FIX", ~bad),
        "needless_confirm": share(a == "CONFIRM", e == "ACCEPT"), "address_right": share(same, ~bad & (a != "FIX")), "silent_wrong": share((a == "ACCEPT") & (bad | ~same), every),
    }
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in out.items()))


def noisy_metrics(rows: DataFrame) -> DataFrame:
    """Rates of a noisy set, whose rows without an address have a null expected_id: found, accepted, rejected, silent errors, junk rejected."""
    has = F.col("expected_id").isNotNull()
    a, same = F.col("action"), F.coalesce(F.col("found_id") == F.col("expected_id"), F.lit(False))
    ok = same & (a != "FIX")
    return rows.agg(F.count("*").alias("n"), share(ok, has).alias("found"), share(ok & (a == "ACCEPT"), has).alias("accepted"), share(a == "FIX", has).alias("rejected"), share((a == "ACCEPT") & ~same, F.lit(True)).alias("silent_wrong"), share(a == "FIX", ~has).alias("junk_rejected"))


def labelled_outcome(found: Column, same: Column, action: Column, resolvable: Column, acceptable: Column, gold: Column) -> Column:
    """false_reject, right_reject, silent_error, wrong_advice, right, missed or needless_confirm."""
    right = F.array_contains(acceptable, action)
    return (
        F.when(~found, F.when(resolvable, "false_reject").otherwise("right_reject")).when(~same, F.when(action.isin(*PASSED), "silent_error").otherwise("wrong_advice"))
        .when(right, "right").when(action == "ACCEPT", "missed").when(gold == "ACCEPT", "needless_confirm").otherwise("right")
    )


def labelled_summary(rows: DataFrame) -> DataFrame:
    """One row of rates over (outcome, action, resolvable, same)."""
    o, a, every = F.col("outcome"), F.col("action"), F.lit(True)
    return rows.agg(
        F.count("*").alias("n"), share(a == "ACCEPT", every).alias("auto_pass"), share(a.isin(*PASSED), every).alias("direct_pass"), share(o == "silent_error", a.isin(*PASSED)).alias("error_in_pass"), share(o == "silent_error", every).alias("silent_error"),
        share(F.col("same"), F.col("resolvable")).alias("resolvable_found"), share(a == "FIX", F.col("resolvable")).alias("false_reject"), share(o.isin("right", "right_reject"), every).alias("decision_right"),
    )


def gate(summary: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(rate, value, limit, passed) for each rate with a limit: (">=" or "<=", figure)."""
    rows = [F.struct(F.lit(k).alias("rate"), F.col(k).alias("value"), F.lit(float(v)).alias("limit"), (F.col(k) >= v if op == ">=" else F.col(k) <= v).alias("passed")) for k, (op, v) in limits.items()]
    return summary.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def unit_key(unit: Column) -> Column:
    """#03-07 as 3-7: floor and unit without leading zeros; basements keep theirs."""
    form = r"^#(B?)0*([0-9]+)-0*([0-9]+[A-Z]?)$"
    return F.when(unit.rlike(form), F.regexp_replace(unit, form, "$1$2-$3"))


def market_outcome(action: Column, level: Column, metres: Column) -> Column:
    """right_passed, right_confirmed, silent_error, wrong_advice, fix or fix_in_area, by the distance that a granularity allows."""
    limit = F.lit(-1.0)
    for k, v in NEAR.items():
        limit = F.when(level == k, float(v)).otherwise(limit)
    ok, passed = F.coalesce(metres <= limit, F.lit(False)), action.isin(*PASSED)
    return F.when(action == "FIX", F.when(ok & (level == "LOCALITY"), "fix_in_area").otherwise("fix")).when(ok, F.when(passed, "right_passed").otherwise("right_confirmed")).otherwise(F.when(passed, "silent_error").otherwise("wrong_advice"))


def market_metrics(rows: DataFrame) -> DataFrame:
    """A market's rates over (market, action, level, metres): right, passed, silent errors, errors of over a kilometre, median distance, share within 500 m."""
    d = rows.withColumn("o", market_outcome(F.col("action"), F.col("level"), F.col("metres")))
    o, m, every = F.col("o"), F.col("metres"), F.lit(True)
    return d.groupBy("market").agg(
        F.count("*").alias("n"), share(o.startswith("right"), every).alias("right"), share(o == "right_passed", every).alias("right_passed"), share(o == "silent_error", every).alias("silent"), share((o == "silent_error") & (m > 1000), every).alias("silent_over_1km"),
        share((o == "wrong_advice") & (m > 1000), every).alias("wrong_over_1km"), F.median("metres").alias("median_metres"), share(m <= 500, every).alias("within_500m"),
    )


def parity(rows: DataFrame, gap: float = 0.03) -> DataFrame:
    """(market, ok, ceiling, verdict): a market is level where its rate of right results is within ``gap`` of what noise and texts without a premise leave possible. ``rows`` (market, class: ok, noise, no_premise or miss)."""
    c, every = F.col("class"), F.lit(True)
    g = rows.groupBy("market").agg(F.count("*").alias("n"), share(c == "ok", every).alias("ok"), (1 - share(c == "no_premise", every) - share(c == "noise", every)).alias("ceiling"))
    return g.withColumn("verdict", F.when(F.col("ceiling") - F.col("ok") <= gap + 1e-9, "level").otherwise("behind"))


def place_label(metres: Column, ok: float = 100, bad: float = 500) -> Column:
    return F.when(metres.isNull(), "none").when(metres <= ok, "ok").when(metres > bad, "bad").otherwise("near")


def failure_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, n): why answers (geo, own, final labels, action) that aren't right and shown aren't: the geocoder was right, the engine was, only near, both wrong, or none had any."""
    fail = rows.where(~((F.col("final") == "ok") & F.col("action").isin("ACCEPT", "CONFIRM")))
    g, own = F.col("geo"), F.col("own") == "ok"
    bucket = F.when(g == "ok", "geocoder_right").when(own, "engine_right").when(g == "near", "near_only").when(g == "bad", "both_wrong").otherwise("nothing")
    return fail.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def coverage_rates(rows: DataFrame) -> DataFrame:
    """Per market and kind (real or made) how often texts known to be inside are said to be OUTSIDE or INSIDE."""
    s = F.col("status")
    return rows.groupBy("market", "kind").agg(F.count("*").alias("n"), share(s == "OUTSIDE", F.lit(True)).alias("false_outside"), share(s == "INSIDE", F.lit(True)).alias("inside"))


def causes(rows: DataFrame) -> DataFrame:
    """(country, cause, n, percent of the country's rows)."""
    from pyspark.sql import Window as W

    g = rows.groupBy("country", "cause").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("country")), 4))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, n): outcomes of two runs over the same ids that differ."""
    j = before.select("id", F.col("outcome").alias("before")).join(after.select("id", F.col("outcome").alias("after")), "id")
    return j.where("before <> after").groupBy("before", "after").agg(F.count("*").alias("n"))


def add_subpremise_as_accept(action: Column) -> Column:
    return F.when(action == "CONFIRM_ADD_SUBPREMISES", "ACCEPT").otherwise(action)
