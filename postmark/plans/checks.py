"""Queries of cross-checking, evaluation and made test texts over the world, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmark.functions import geo
from postmark.functions import text as T
from postmark.operators import crosscheck as C
from postmark.operators import evaluation as E
from postmark.operators import evidence, resolve
from postmark.operators import synthesis as Y
from postmark.operators.lineage import cut
from postmark.plans.catalog import _HAVERSINE, query

_TITLE = "array_to_string(list_transform(string_split(lower({}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"

#: The same for names that may hold numbers or several blanks.
_SHOWN = "array_to_string(list_transform(string_split(trim(regexp_replace({}, ' +', ' ', 'g')), ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN x ELSE upper(x[1]) || lower(x[2:]) END), ' ')"


def _metres(a: str, b: str) -> str:
    return "(" + _HAVERSINE.format(a=a, b=b) + ")"


def _chance(seed: str, salt: str, n: int | str) -> str:
    return f"(('0x' || substr(md5({seed} || '{salt}'), 1, 6))::BIGINT % {n})"


# ---- cross-checks ---------------------------------------------------------------------------------------------------
@query("""
SELECT street_id, CASE street_id % 7 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'CORRECTED' WHEN 2 THEN 'CONFLICT' WHEN 3 THEN 'INFERRED' WHEN 4 THEN 'CONFLICT' WHEN 5 THEN 'CONFIRMED' ELSE 'CORRECTED' END AS verdict FROM street""")
def route_agreement(w):
    k, words = F.col("street_id") % 7, F.split("name", " ")
    answer = F.when(k == 4, "STREET 7").when(k == 5, "STREET 7").when(k == 6, "AVENUE 7").otherwise(F.concat(F.col("name"), F.lit(" ZANZIBAR")))
    written = (
        F.when(k == 0, F.concat_ws(" ", words[0], words[1], F.lit("ZANZIBAR"))).when(k == 1, F.concat_ws(" ", words[0], words[1], F.lit("ZANZBAR"))).when(k == 2, "QUITE OTHER").when(k == 3, "12").when(k == 4, "STREET 8").otherwise("STREET 7")
    )
    return w.street.select("street_id", C.route_match(["STREET", "ROAD", "AVENUE", "LANE"])(answer, written).alias("verdict"))


_VERDICTS = ["CONFIRMED", "CORRECTED", "CONFLICT", "INFERRED"]


@query("""
, v AS (SELECT point_id, ['CONFIRMED','CORRECTED','CONFLICT','INFERRED'][(point_id % 4)::INT + 1] AS r, ['CONFIRMED','CORRECTED','CONFLICT','INFERRED'][(point_id // 4 % 4)::INT + 1] AS t FROM point)
SELECT point_id, CASE WHEN r = t OR r = 'INFERRED' THEN t WHEN r = 'CONFIRMED' THEN CASE WHEN t = 'CONFLICT' THEN 'CORRECTED' ELSE r END WHEN r = 'CORRECTED' THEN CASE WHEN t = 'CONFIRMED' THEN t ELSE r END
  ELSE CASE WHEN t IN ('CONFIRMED', 'CORRECTED') THEN 'CORRECTED' ELSE r END END AS verdict FROM v""")
def combined_verdicts(w):
    names = F.array(*(F.lit(v) for v in _VERDICTS))
    k = F.col("point_id")
    return w.point.select("point_id", C.combine(F.get(names, (k % 4).cast("int")), F.get(names, (F.floor(k / 4) % 4).cast("int"))).alias("verdict"))


@query(f"""
, a AS (SELECT i.input_id AS id, i.name AS key, i.street_id, p.lat, p.lng, p.blk AS nkey FROM input AS i JOIN point AS p ON p.street_id = i.street_id AND p.number = i.number)
SELECT id, EXISTS (SELECT 1 FROM street AS s WHERE s.name = a.key AND {_metres("a.", "s.")} > 300 AND {_metres("a.", "s.")} <= 5000) AS twin,
  EXISTS (SELECT 1 FROM street AS s JOIN point AS q USING (street_id) WHERE s.name = a.key AND q.blk = a.nkey AND {_metres("a.", "s.")} > 2000) AS elsewhere FROM a""")
def homonym_checks(w):
    p = w.point.select("street_id", "number", "lat", "lng", F.col("blk").alias("nkey"))
    a = w.input.select(F.col("input_id").alias("id"), F.col("name").alias("key"), "street_id", "number").join(p, ["street_id", "number"]).drop("street_id", "number")
    s = w.street.select("street_id", F.col("name").alias("key"), F.col("lat").alias("slat"), F.col("lng").alias("slng"))
    return C.elsewhere(C.homonyms_near(a, s), s, p).select("id", "twin", "elsewhere")


@query(f"""
SELECT place_id, CASE WHEN lat BETWEEN 1.1 AND 1.2 AND lng BETWEEN 103.1 AND 103.2 THEN 2 WHEN {_HAVERSINE.format(a="", b="c")} <= 3000 + 2000 * log10(greatest(population, 1000) / 1000.0) THEN 1 ELSE 0 END AS position
FROM (SELECT *, least(greatest(lat, 1.1), 1.2) AS clat, least(greatest(lng, 103.1), 103.2) AS clng FROM place)""")
def pilot_positions(w):
    return w.place.select("place_id", C.pilot_position(F.col("lat"), F.col("lng"), F.col("population"), [(103.1, 1.1, 103.2, 1.2)]).alias("position"))


@query("""
, c AS (SELECT point_id AS id, ['BR','GB','CA','NL','AU'][(point_id % 5)::INT + 1] AS market, lpad(postal, 8, '1') AS code FROM point)
SELECT id, CASE WHEN market = 'BR' THEN 'town' WHEN market = 'GB' THEN 'outward' WHEN market IN ('CA', 'NL') THEN 'prefix' END AS place FROM c WHERE market <> 'AU'""")
def postcode_places(w):
    k = F.col("point_id")
    market = F.get(F.array(*(F.lit(x) for x in ("BR", "GB", "CA", "NL", "AU"))), (k % 5).cast("int"))
    codes = w.point.select(k.alias("id"), market.alias("market"), F.lpad("postal", 8, "1").alias("postcode"))
    p = F.col("postcode")
    places = codes.select("market", F.when(F.col("market") == "BR", F.concat(F.substring(p, 1, 5), F.lit("000"))).when(F.col("market") == "GB", F.substring(p, 1, 5)).when(F.col("market") == "CA", F.substring(p, 1, 3)).otherwise(F.substring(p, 1, 4)).alias("postcode"), F.when(F.col("market") == "BR", "town").when(F.col("market") == "GB", "outward").otherwise("prefix").alias("place")).distinct()
    return C.postcode_place(codes, places.where("market <> 'AU'"))


@query("SELECT input_id AS id, CASE input_id % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'FIX' ELSE 'CONFIRM' END AS action FROM input")
def reference_free_actions(w):
    k = F.col("input_id")
    return w.input.select(k.alias("id"), C.free_action(F.when(k % 4 == 1, "REJECTED").when(k % 4 == 2, "PLAUSIBLE").otherwise("VERIFIED"), F.when(k % 4 != 3, True)).alias("action"))


@query("SELECT input_id AS id, input_id % 3 = 0 AS is_foreign FROM input")
def foreign_texts(w):
    k = F.col("input_id")
    text = F.when(k % 3 == 0, F.concat_ws(" ", F.col("name"), F.lit("Johor 81300"))).when(k % 3 == 1, F.concat_ws(" ", F.col("name"), F.lit("Johor 081300"))).otherwise(F.col("name"))
    return w.input.select(k.alias("id"), C.foreign(text, ["JOHOR", "MALAYSIA"]).alias("is_foreign"))


@query("SELECT input_id AS id, input_id % 4 <> 3 AS address_like FROM input")
def address_likeness(w):
    k, name = F.col("input_id"), F.split("name", " ")
    words = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.array(F.lit("AT"), F.lit("12")), name)).when(k % 4 == 2, F.array(F.lit("GRAND"), F.lit("TOWER"))).otherwise(F.array(F.lit("CALL"), F.lit("ME")))
    buildings = w.spark.createDataFrame([("GRAND TOWER",)], "name string")
    return C.address_like(w.input.select(k.alias("id"), words.alias("words")), w.street.select(F.col("name").alias("key")), buildings).select("id", "address_like")


# ---- evidence -------------------------------------------------------------------------------------------------------
_LEVELS = """l AS (SELECT i.input_id AS id, p.point_id AS eid, CASE WHEN p.postal = i.truth_postal THEN 'exact' WHEN i.input_id % 5 = 0 THEN 'absent' ELSE 'mismatch' END AS postal, CASE WHEN p.blk = i.number::VARCHAR THEN 'exact' WHEN p.number = i.number THEN 'letter' ELSE 'mismatch' END AS block,
  CASE WHEN p.number % 2 = 0 THEN 'exact' ELSE 'corrected' END AS street, p.number = i.number AS is_true FROM input AS i JOIN point AS p ON p.street_id = i.street_id AND abs(p.number - i.number) <= 1)"""


def _levels(w):
    i = w.input.select(F.col("input_id").alias("id"), "street_id", F.col("number").alias("typed"), "truth_postal").withColumn("number", F.explode(F.array(F.col("typed") - 1, F.col("typed"), F.col("typed") + 1)))
    j = i.join(w.point.select("street_id", "number", "point_id", F.col("postal").alias("code"), "blk"), ["street_id", "number"])
    return j.select(
        "id", F.col("point_id").alias("eid"), F.when(F.col("code") == F.col("truth_postal"), "exact").when(F.col("id") % 5 == 0, "absent").otherwise("mismatch").alias("postal"),
        F.when(F.col("blk") == F.col("typed").cast("string"), "exact").when(F.col("number") == F.col("typed"), "letter").otherwise("mismatch").alias("block"),
        evidence.compare_street(F.lit(True), F.col("number") % 2 == 0, F.lit(False)).alias("street"), (F.col("number") == F.col("typed")).alias("is_true"),
    )


@query(f"""
, {_LEVELS}, n AS (SELECT postal || '|' || block || '|' || street AS pattern, count(*) FILTER (WHERE is_true) AS m, count(*) FILTER (WHERE NOT is_true) AS u FROM l GROUP BY 1), t AS (SELECT sum(m) AS tm, sum(u) AS tu, count(*) AS k FROM n)
SELECT pattern, round(log2(((m + 0.5) / (tm + 0.5 * k)) / ((u + 0.5) / (tu + 0.5 * k))), 6) AS weight FROM n, t WHERE m + u >= 5""")
def joint_patterns(w):
    rows = _levels(w).withColumn("pattern", evidence.pattern(F.col("postal"), F.col("block"), F.col("street")))
    return evidence.fit_patterns(rows).select("pattern", F.round("weight", 6).alias("weight"))


@query(f"""
, {_LEVELS} SELECT id, eid, round(CASE WHEN postal = 'exact' AND block = 'exact' AND street = 'exact' THEN 9.0 ELSE CASE postal WHEN 'exact' THEN 4.0 WHEN 'mismatch' THEN -3.0 ELSE 0 END + CASE block WHEN 'exact' THEN 2.0 ELSE 0 END END + CASE WHEN eid % 2 = 0 THEN 1.5 ELSE 0 END, 6)::DOUBLE AS evidence FROM l""")
def joint_evidence(w):
    weights = w.spark.createDataFrame([("postal", "exact", 4.0), ("postal", "mismatch", -3.0), ("block", "exact", 2.0), ("building", "match", 1.5)], "field string, level string, weight double")
    patterns = w.spark.createDataFrame([("exact|exact|exact", 9.0)], "pattern string, weight double")
    rows = _levels(w).withColumn("building", F.when(F.col("eid") % 2 == 0, "match").otherwise("absent"))
    return evidence.joint_evidence(rows, ["postal", "block", "street"], weights, patterns, "building").select("id", "eid", F.round("evidence", 6).alias("evidence"))


@query(f"""
, {_LEVELS}, c AS (SELECT id, eid, CASE WHEN is_true THEN (50 + id % 50) / 100.0 ELSE (id % 10) / 100.0 END::DOUBLE AS p, is_true FROM l), b AS (SELECT id, arg_max(eid, (p, -eid)) AS eid, max(p) AS p, sum(p) AS s, max(CASE WHEN id % 3 = 0 THEN eid ELSE -1 END) AS rule FROM c GROUP BY id)
SELECT id, CASE WHEN p >= 0.5 THEN eid END AS eid, CASE WHEN p < 0.5 THEN 'FIX' WHEN eid = rule AND p >= 0.95 THEN 'ACCEPT' ELSE 'CONFIRM' END AS action, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - s END, 9) AS confidence FROM b""")
def posterior_selection(w):
    k = F.col("id")
    c = _levels(w).withColumn("posterior", F.when(F.col("is_true"), (50 + k % 50) / 100).otherwise((k % 10) / 100))
    rule = c.groupBy("id").agg(F.max(F.when(k % 3 == 0, F.col("eid")).otherwise(-1)).alias("rule_eid"))
    c = c.join(rule, "id").withColumn("rule_action", F.lit("ACCEPT"))
    return evidence.select_by_posterior(c.select("id", "eid", "posterior", "rule_eid", "rule_action"), "BALANCED").select("id", "eid", "action", F.round("confidence", 9).alias("confidence"))


@query("SELECT point_id, CASE WHEN point_id % 3 = 0 THEN 'absent' WHEN building IS NOT NULL AND point_id % 2 = 0 THEN 'match' ELSE 'nomatch' END AS building FROM point")
def building_levels(w):
    k = F.col("point_id")
    rows = w.point.select("point_id", F.when(k % 3 == 0, "").when(k % 2 == 0, F.coalesce(F.concat(F.lit("NEW "), "building"), F.lit("NO SUCH HOUSE"))).otherwise("ZZZ YYY").alias("rest"), F.array("building", F.lit("QQQ")).alias("buildings"))
    return evidence.compare_building(rows, ["point_id"], "rest", "buildings")


# ---- evaluation -----------------------------------------------------------------------------------------------------
_RUN = """u AS (SELECT i.input_id AS id, p.point_id, CASE WHEN p.point_id IS NULL THEN 'FIX' WHEN p.blk <> i.number::VARCHAR THEN 'CONFIRM' WHEN i.input_id % 6 IN (1, 5) THEN 'CONFIRM' WHEN i.input_id % 6 = 2 THEN 'CONFIRM_ADD_SUBPREMISES' ELSE 'ACCEPT' END AS action, i.number, s.lat, s.lng, p.lat AS plat, p.lng AS plng, s.area_id, i.input_id % 6 AS form
  FROM input AS i JOIN street AS s USING (street_id) LEFT JOIN point AS p ON p.street_id = i.street_id AND p.number = i.number)"""


def _run(w):
    """What a plain resolver gives for each input: the point of its street and number, or FIX."""
    i = w.input.select(F.col("input_id").alias("id"), "street_id", "number").join(w.street.select("street_id", "lat", "lng", "area_id"), "street_id")
    p = w.point.select("street_id", "number", "point_id", "blk", F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    form = F.col("id") % 6
    action = F.when(F.col("point_id").isNull(), "FIX").when((F.col("blk") != F.col("number").cast("string")) | form.isin(1, 5), "CONFIRM").when(form == 2, "CONFIRM_ADD_SUBPREMISES").otherwise("ACCEPT")
    return i.join(p, ["street_id", "number"], "left").withColumn("action", action).withColumn("form", form)


def _share(part: str, of: str = "true") -> str:
    return f"coalesce(count(*) FILTER (WHERE ({of}) AND ({part})) / nullif(count(*) FILTER (WHERE {of}), 0), 0)::DOUBLE"


@query(f"""
, {_RUN}, g AS (SELECT *, CASE WHEN form = 5 THEN 'FIX' WHEN form IN (0, 2, 3) THEN 'ACCEPT' ELSE 'CONFIRM' END AS e, CASE WHEN action = 'CONFIRM_ADD_SUBPREMISES' THEN 'ACCEPT' ELSE action END AS a, CASE WHEN form <> 4 THEN point_id END AS x FROM u)
SELECT form::INT AS form, count(*) AS n, {_share("a = e AND (e = 'FIX' OR coalesce(x = point_id, false))")} AS full_correct, {_share("a = e")} AS action_right, {_share("a = 'ACCEPT'", "e = 'FIX'")} AS false_accept, {_share("a = 'FIX'", "e = 'FIX'")} AS fix_recall, {_share("a = 'FIX'", "e <> 'FIX'")} AS false_reject,
  {_share("a = 'CONFIRM'", "e = 'ACCEPT'")} AS needless_confirm, {_share("coalesce(x = point_id, false)", "e <> 'FIX' AND a <> 'FIX'")} AS address_right, {_share("a = 'ACCEPT' AND (e = 'FIX' OR NOT coalesce(x = point_id, false))")} AS silent_wrong FROM g GROUP BY 1""")
def golden_rates(w):
    f = F.col("form")
    rows = _run(w).select(f.cast("int").alias("form"), F.when(f == 5, "FIX").when(f.isin(0, 2, 3), "ACCEPT").otherwise("CONFIRM").alias("expected"), F.when(f != 4, F.col("point_id")).alias("expected_id"), E.add_subpremise_as_accept(F.col("action")).alias("action"), F.col("point_id").alias("found_id"))
    return E.golden_metrics(rows, ["form"])


@query(f"""
, {_RUN}, g AS (SELECT *, CASE WHEN form < 4 THEN point_id END AS x FROM u)
SELECT count(*) AS n, {_share("x = point_id AND action <> 'FIX'", "x IS NOT NULL")} AS found, {_share("x = point_id AND action = 'ACCEPT'", "x IS NOT NULL")} AS accepted, {_share("action = 'FIX'", "x IS NOT NULL")} AS rejected, {_share("action = 'ACCEPT' AND NOT coalesce(x = point_id, false)")} AS silent_wrong, {_share("action = 'FIX'", "x IS NULL")} AS junk_rejected FROM g""")
def noisy_rates(w):
    return E.noisy_metrics(_run(w).select(F.when(F.col("form") < 4, F.col("point_id")).alias("expected_id"), "action", F.col("point_id").alias("found_id")))


_OUT = "CASE WHEN point_id IS NULL THEN CASE WHEN form < 3 THEN 'false_reject' ELSE 'right_reject' END WHEN form = 4 THEN CASE WHEN action IN ('ACCEPT', 'CONFIRM_ADD_SUBPREMISES') THEN 'silent_error' ELSE 'wrong_advice' END WHEN action = 'CONFIRM' OR (form = 2 AND action = 'CONFIRM_ADD_SUBPREMISES') THEN 'right' WHEN action = 'ACCEPT' THEN 'missed' ELSE 'right' END"


def _labelled(w):
    f = F.col("form")
    acceptable = F.when(f == 2, F.array(F.lit("CONFIRM"), F.lit("CONFIRM_ADD_SUBPREMISES"))).otherwise(F.array(F.lit("CONFIRM")))
    r = _run(w).withColumns({"found": F.col("point_id").isNotNull(), "same": F.col("point_id").isNotNull() & (f != 4), "resolvable": f < 3})
    return r.withColumn("outcome", E.labelled_outcome(F.col("found"), F.col("same"), F.col("action"), F.col("resolvable"), acceptable, F.lit("CONFIRM")))


@query(f", {_RUN} SELECT id, {_OUT} AS outcome FROM u")
def labelled_outcomes(w):
    return _labelled(w).select("id", "outcome")


@query(f"""
, {_RUN}, o AS (SELECT *, {_OUT} AS outcome, point_id IS NOT NULL AND form <> 4 AS same FROM u)
SELECT count(*) AS n, {_share("action = 'ACCEPT'")} AS auto_pass, {_share("action IN ('ACCEPT', 'CONFIRM_ADD_SUBPREMISES')")} AS direct_pass, {_share("outcome = 'silent_error'", "action IN ('ACCEPT', 'CONFIRM_ADD_SUBPREMISES')")} AS error_in_pass, {_share("outcome = 'silent_error'")} AS silent_error,
  {_share("same", "form < 3")} AS resolvable_found, {_share("action = 'FIX'", "form < 3")} AS false_reject, {_share("outcome IN ('right', 'right_reject')")} AS decision_right FROM o""")
def labelled_rates(w):
    return E.labelled_summary(_labelled(w))


@query(f"""
, {_RUN}, o AS (SELECT {_share("action = 'ACCEPT'")} AS p FROM u) SELECT 'auto_pass' AS rate, p AS value, 0.05::DOUBLE AS "limit", p >= 0.05 AS passed FROM o""")
def gated_rates(w):
    return E.gate(E.labelled_summary(_labelled(w)).select("auto_pass"), {"auto_pass": (">=", 0.05)})


@query("SELECT point_id, CASE point_id % 3 WHEN 0 THEN (number || '-' || (number + 1)) WHEN 1 THEN 'B2-' || number ELSE NULL END AS unit FROM point")
def unit_keys(w):
    n = F.col("number")
    unit = F.when(F.col("point_id") % 3 == 0, F.concat(F.lit("#"), F.lpad(n.cast("string"), 3, "0"), F.lit("-0"), (n + 1).cast("string"))).when(F.col("point_id") % 3 == 1, F.concat(F.lit("#B2-"), n.cast("string"))).otherwise("Level 3")
    return w.point.select("point_id", E.unit_key(unit).alias("unit"))


_MARKET = f"""{_RUN}, k AS (SELECT area_id % 5 AS market, action, CASE WHEN point_id IS NULL THEN 'LOCALITY' WHEN form = 4 THEN 'ROUTE' ELSE 'PREMISE' END AS level, CASE WHEN form = 3 THEN NULL ELSE {_metres("", "p")} * CASE WHEN form = 4 THEN 40 ELSE 1 END END AS m FROM u),
o AS (SELECT *, coalesce(m <= CASE level WHEN 'LOCALITY' THEN 3000 ELSE 250 END, false) AS ok FROM k),
q AS (SELECT *, CASE WHEN action = 'FIX' THEN CASE WHEN ok AND level = 'LOCALITY' THEN 'fix_in_area' ELSE 'fix' END WHEN ok THEN CASE WHEN action IN ('ACCEPT', 'CONFIRM_ADD_SUBPREMISES') THEN 'right_passed' ELSE 'right_confirmed' END WHEN action IN ('ACCEPT', 'CONFIRM_ADD_SUBPREMISES') THEN 'silent_error' ELSE 'wrong_advice' END AS o FROM o)"""


@query(f"""
, {_MARKET} SELECT market::INT AS market, count(*) AS n, {_share("o LIKE 'right%'")} AS right_, {_share("o = 'right_passed'")} AS right_passed, {_share("o = 'silent_error'")} AS silent, {_share("o = 'silent_error' AND m > 1000")} AS silent_over_1km, {_share("o = 'wrong_advice' AND m > 1000")} AS wrong_over_1km,
  round(median(m), 6) AS median_metres, {_share("m <= 500")} AS within_500m FROM q GROUP BY 1""")
def market_rates(w):
    m = geo.haversine(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng")) * F.when(F.col("form") == 4, 40).otherwise(1)
    level = F.when(F.col("point_id").isNull(), "LOCALITY").when(F.col("form") == 4, "ROUTE").otherwise("PREMISE")
    rows = _run(w).select((F.col("area_id") % 5).cast("int").alias("market"), "action", level.alias("level"), F.when(F.col("form") != 3, m).alias("metres"))
    return E.market_metrics(rows).withColumnRenamed("right", "right_").withColumn("median_metres", F.round("median_metres", 6))


@query(f"""
, {_RUN}, c AS (SELECT area_id % 7 AS market, CASE WHEN point_id IS NULL THEN CASE WHEN area_id % 2 = 0 THEN 'no_premise' ELSE 'miss' END WHEN form = 4 THEN 'noise' ELSE 'ok' END AS class FROM u),
g AS (SELECT market, count(*) AS n, {_share("class = 'ok'")} AS ok, 1 - {_share("class = 'no_premise'")} - {_share("class = 'noise'")} AS ceiling FROM c GROUP BY 1)
SELECT market::INT AS market, n, round(ok, 9) AS ok, round(ceiling, 9) AS ceiling, CASE WHEN ceiling - ok <= 0.03 + 1e-9 THEN 'level' ELSE 'behind' END AS verdict FROM g""")
def parity_classes(w):
    cls = F.when(F.col("point_id").isNull(), F.when(F.col("area_id") % 2 == 0, "no_premise").otherwise("miss")).when(F.col("form") == 4, "noise").otherwise("ok")
    return E.parity(_run(w).select((F.col("area_id") % 7).cast("int").alias("market"), cls.alias("class"))).select("market", "n", F.round("ok", 9).alias("ok"), F.round("ceiling", 9).alias("ceiling"), "verdict")


@query(f"""
, {_RUN}, k AS (SELECT *, {_metres("", "p")} * CASE form WHEN 4 THEN 20 WHEN 3 THEN 3 ELSE 1 END AS m FROM u), l AS (SELECT *, CASE WHEN m IS NULL THEN 'none' WHEN m <= 100 THEN 'ok' WHEN m > 500 THEN 'bad' ELSE 'near' END AS geo, CASE WHEN form < 2 THEN 'ok' ELSE 'bad' END AS own FROM k)
SELECT CASE WHEN geo = 'ok' THEN 'geocoder_right' WHEN own = 'ok' THEN 'engine_right' WHEN geo = 'near' THEN 'near_only' WHEN geo = 'bad' THEN 'both_wrong' ELSE 'nothing' END AS bucket, count(*) AS n FROM l WHERE NOT (geo = 'ok' AND action IN ('ACCEPT', 'CONFIRM')) GROUP BY 1""")
def failure_buckets(w):
    m = geo.haversine(F.col("lat"), F.col("lng"), F.col("plat"), F.col("plng")) * F.when(F.col("form") == 4, 20).when(F.col("form") == 3, 3).otherwise(1)
    label = E.place_label(m)
    return E.failure_buckets(_run(w).select("action", label.alias("geo"), label.alias("final"), F.when(F.col("form") < 2, "ok").otherwise("bad").alias("own")))


@query(f"""
, {_RUN}, c AS (SELECT area_id % 5 AS market, CASE WHEN form < 3 THEN 'real' ELSE 'made' END AS kind, CASE WHEN point_id IS NULL THEN 'OUTSIDE' WHEN form = 1 THEN 'UNKNOWN' ELSE 'INSIDE' END AS status FROM u)
SELECT market::INT AS market, kind, count(*) AS n, {_share("status = 'OUTSIDE'")} AS false_outside, {_share("status = 'INSIDE'")} AS inside FROM c GROUP BY 1, 2""")
def coverage_rates(w):
    rows = _run(w).select((F.col("area_id") % 5).cast("int").alias("market"), F.when(F.col("form") < 3, "real").otherwise("made").alias("kind"), F.when(F.col("point_id").isNull(), "OUTSIDE").when(F.col("form") == 1, "UNKNOWN").otherwise("INSIDE").alias("status"))
    return E.coverage_rates(rows)


@query(f", {_RUN} SELECT country::INT AS country, cause, n, round(100.0 * n / sum(n) OVER (PARTITION BY country), 4) AS percent FROM (SELECT area_id % 5 AS country, action AS cause, count(*) AS n FROM u GROUP BY 1, 2)")
def causes_by_country(w):
    return E.causes(_run(w).select((F.col("area_id") % 5).cast("int").alias("country"), F.col("action").alias("cause")))


@query(f", {_RUN} SELECT action AS before, CASE WHEN form = 0 THEN 'CONFIRM' ELSE action END AS after, count(*) AS n FROM u WHERE form = 0 AND action <> 'CONFIRM' GROUP BY 1, 2")
def compared_runs(w):
    r = _run(w)
    return E.compare_runs(r.select("id", F.col("action").alias("outcome")), r.select("id", F.when(F.col("form") == 0, "CONFIRM").otherwise(F.col("action")).alias("outcome")))


# ---- made texts -----------------------------------------------------------------------------------------------------
def _typo(word: str, seed: str) -> str:
    at, kind, letter = f"({_chance(seed, 'place', f'greatest(length({word}) - 2, 1)')} + 2)", _chance(seed, "kind", 4), f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', ({_chance(seed, 'letter', 26)} + 1)::INT, 1)"
    own = f"substr({word}, {at}::INT, 1)"
    return f"""CASE WHEN length({word}) < 3 THEN {word} WHEN {kind} = 0 THEN substr({word}, 1, ({at} - 1)::INT) || substr({word}, ({at} + 1)::INT) WHEN {kind} = 1 THEN substr({word}, 1, ({at} - 1)::INT) || CASE WHEN {letter} = {own} THEN 'X' ELSE {letter} END || substr({word}, ({at} + 1)::INT)
  WHEN {kind} = 2 THEN substr({word}, 1, ({at} - 1)::INT) || {own} || {own} || substr({word}, ({at} + 1)::INT) ELSE substr({word}, 1, ({at} - 2)::INT) || {own} || substr({word}, ({at} - 1)::INT, 1) || substr({word}, ({at} + 1)::INT) END"""


@query(f"""
, w AS (SELECT point_id, string_split(name, ' ')[1] AS word, postal FROM point), s AS (SELECT *, ({_chance("point_id", "slip", 1000)} % 6 + 1)::INT AS pos FROM w)
SELECT point_id, {_typo("word", "point_id")} AS typed, substr(postal, 1, pos - 1) || ((substr(postal, pos, 1)::INT + 1) % 10) || substr(postal, pos + 1) AS slipped FROM s""")
def typos(w):
    return w.point.select("point_id", Y.typo(F.split("name", " ")[0], F.col("point_id")).alias("typed"), Y.digit_slip(F.col("postal"), F.col("point_id")).alias("slipped"))


@query("""
, h AS (SELECT point_id, string_split(name, ' ') AS ws, ('0x' || substr(md5(point_id || '2'), 1, 6))::BIGINT AS h FROM point),
o AS (SELECT *, CASE ws[3] WHEN 'STREET' THEN ['ST', 'STR'] WHEN 'ROAD' THEN ['RD'] WHEN 'AVENUE' THEN ['AVE', 'AV', 'AVN'] WHEN 'LANE' THEN ['LN'] END AS said FROM h)
SELECT point_id, ws[1] || ' ' || ws[2] || ' ' || CASE WHEN h % 5 < 4 THEN said[(h // 5 % len(said))::INT + 1] ELSE ws[3] END AS short FROM o""")
def abbreviated_roads(w):
    return w.point.select("point_id", Y.abbreviated(F.col("name"), F.col("point_id")).alias("short"))


def _entities(w):
    return w.point.select(F.col("point_id").alias("eid"), "blk", F.col("name").alias("road"), "postal", "building")


_GOLDEN = f"""own AS (SELECT blk, name FROM point GROUP BY 1, 2 HAVING count(*) = 1), e AS (SELECT point_id AS eid, blk, name AS road, postal, building, string_split(name, ' ')[1] AS a, substr(name, length(string_split(name, ' ')[1]) + 1) AS z, {_chance("point_id", "golden", 10)}::INT AS c,
  {_chance("point_id", "tail", 2)} = 0 AS tailed, lpad(({_chance("point_id", "floor", 12)} + 1)::VARCHAR, 2, '0') AS f, lpad(({_chance("point_id", "unit", 99)} + 1)::VARCHAR, 2, '0') AS u FROM point SEMI JOIN own USING (blk, name)),
g AS (SELECT *, {_TITLE.format("road")} AS shown, {_typo("a", "eid")} || z AS bad FROM e)"""


@query(f"""
, {_GOLDEN} SELECT eid, ['A_clean','B_messy','C_typo','D1_no_postcode','D2_no_block','E_wrong_postcode','F1_no_such_block','F2_no_such_street','G_building','I_unit'][c + 1] AS category,
  CASE c WHEN 0 THEN blk || ' ' || shown || ', Singapore ' || postal WHEN 1 THEN lower('s''pore ' || postal || ' blk ' || blk || '  ' || road) WHEN 2 THEN blk || ' ' || {_TITLE.format("bad")} || CASE WHEN tailed THEN ', Singapore ' || postal ELSE '' END WHEN 3 THEN blk || ' ' || shown WHEN 4 THEN shown || ', Singapore'
  WHEN 5 THEN blk || ' ' || shown || ', Singapore 99' || substr(postal, 3, 4) WHEN 6 THEN '9' || regexp_extract(blk, '^[0-9]+') || '9 ' || shown || ', Singapore' WHEN 7 THEN blk || ' Qwz' || lower(reverse(a)) || ' Road, Singapore'
  WHEN 8 THEN array_to_string(list_transform(string_split(building, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN x ELSE upper(x[1]) || lower(x[2:]) END), ' ') ELSE blk || ' ' || shown || ' #' || f || '-' || u || ', Singapore ' || postal END AS text,
  CASE WHEN c IN (0, 1, 9) THEN 'ACCEPT' WHEN c IN (4, 6, 7) THEN 'FIX' ELSE 'CONFIRM' END AS expected, CASE WHEN c NOT IN (4, 6, 7) THEN eid END AS expected_id FROM g WHERE c <> 8 OR building IN (SELECT building FROM point WHERE building IS NOT NULL GROUP BY 1 HAVING count(*) = 1)""")
def golden_set(w):
    return Y.golden(_entities(w))


@query(f"""
, b AS (SELECT point_id AS eid, blk || ' ' || name || ', Singapore ' || postal AS text, {_chance("point_id", "noisy", 6)}::INT AS c, '9' || lpad({_chance("point_id", "phone", 10_000_000)}::VARCHAR, 7, '0') AS ph FROM point)
SELECT eid, ['N1_contact','N2_recipient','N3_note','N5_glued','N8_mixed','N9_none'][c + 1] AS category, CASE c WHEN 0 THEN text || ', call ' || ph WHEN 1 THEN 'Attn: Ms Tan, ' || text WHEN 2 THEN text || ', please leave at door' WHEN 3 THEN upper(replace(text, ', ', ','))
  WHEN 4 THEN 'Acme Pte Ltd; ' || text || ' ; tel ' || ph || ' ; a' || eid || '@example.com' ELSE 'please call ' || ph END AS text, CASE WHEN c IN (0, 4, 5) THEN ph END AS phone, CASE WHEN c <> 5 THEN eid END AS expected_id FROM b""")
def noisy_set(w):
    text = F.concat(F.col("blk"), F.lit(" "), F.col("name"), F.lit(", Singapore "), F.col("postal"))
    return Y.noisy(w.point.select(F.col("point_id").alias("eid"), text.alias("text")))


@query(f"""
, b AS (SELECT p.point_id, number || ' ' || {_TITLE.format("p.name")} AS line, string_split(p.name, ' ')[1] AS a, substr(p.name, length(string_split(p.name, ' ')[1]) + 1) AS z, number, area AS suburb, postal FROM point AS p JOIN area USING (area_id)),
c AS (SELECT *, {_SHOWN.format("suburb")} AS town, {_typo("a", "point_id")} || z AS bad, {_typo("suburb", "point_id")} AS off FROM b)
SELECT point_id, unnest(['full', 'typo_street', 'typo_suburb', 'no_postcode', 'postcode_only', 'line_only', 'messy']) AS variant, unnest([line || ', ' || town || ' ' || postal, number || ' ' || {_TITLE.format("bad")} || ', ' || town || ' ' || postal, line || ', ' || {_SHOWN.format("off")} || ' ' || postal, line || ', ' || town,
  line || ' ' || postal, line, lower('attn: j. smith ' || line || ' ' || town || ' ' || postal || ' ph 0412 345 678')]) AS text FROM c""")
def base_table_queries(w):
    p = w.point.join(w.area, "area_id").select("point_id", "number", F.col("name").alias("road"), F.col("area").alias("suburb"), F.col("postal").alias("postcode"))
    return Y.base_queries(p)


@query(f"""
, t AS (SELECT i.input_id AS id, p.point_id, p.street_id, p.name, p.blk AS nkey, p.lat, p.lng FROM input AS i JOIN point AS p ON p.street_id = i.street_id AND p.number = i.number)
SELECT id, unnest(['right', 'street_only', 'none']) AS fault, unnest([point_id, NULL, NULL]) AS point_id FROM t
UNION ALL SELECT t.id, 'number', min(o.point_id) FROM t JOIN point AS o ON o.street_id = t.street_id AND o.blk <> t.nkey WHERE {_metres("t.", "o.")} > 150 GROUP BY 1
UNION ALL SELECT t.id, 'homonym', arg_min(o.point_id, (o.blk <> t.nkey, o.point_id)) FROM t JOIN point AS o ON o.name = t.name AND o.street_id <> t.street_id WHERE {_metres("t.", "o.")} > 2000 GROUP BY 1""")
def geocoder_faults(w):
    p = w.point.select("point_id", "street_id", "name", F.col("blk").alias("nkey"), "lat", "lng", "number")
    t = w.input.select(F.col("input_id").alias("id"), "street_id", "number").join(p, ["street_id", "number"])
    return Y.geocoder_faults(t.drop("number"), p.drop("number"))


@query()
def golden_evaluation(w):
    """The resolver over a golden set of every entity, by category. SQL can't express the resolver."""
    cases = cut(golden_set(w))
    rows = w.point.select("blk", F.col("name").alias("road"), "postal", F.col("building").alias("buildings"), "lat", "lng")
    e = cut(resolve.reference(rows))
    got = resolve.validate(cases.select(F.col("eid").alias("id"), "text"), e).select("id", "action", "eid")
    own = w.point.select(F.col("point_id").alias("expected_id"), F.xxhash64("blk", F.col("name"), "postal").alias("truth"))
    j = cases.join(own, "expected_id", "left").join(got.select("id", "action", F.col("eid").alias("found_id")), F.col("eid") == F.col("id"))
    return E.golden_metrics(j.select("category", "expected", F.col("truth").alias("expected_id"), E.add_subpremise_as_accept(F.col("action")).alias("action"), "found_id"), ["category"])
