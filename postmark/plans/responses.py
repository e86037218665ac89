"""Queries of the response operators over the world, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmark.functions import text as T
from postmark.operators import response as R
from postmark.plans.catalog import _HAVERSINE, query

_TITLE = "array_to_string(list_transform(string_split(lower({}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_RESULT = """r AS (SELECT i.input_id AS id, p.point_id IS NOT NULL AS found, coalesce(p.blk, i.number::VARCHAR) AS blk, i.name AS road,
  CASE i.input_id % 6 WHEN 1 THEN NULL WHEN 5 THEN NULL WHEN 4 THEN lpad(((i.street_id * 50 + i.number * 3 + 1) % 1000000)::VARCHAR, 6, '0') ELSE i.truth_postal END AS typed_postal, i.number::VARCHAR AS typed_blk, p.postal AS own, p.building, p.lat,
  CASE WHEN i.input_id % 6 = 2 THEN '#05-' || lpad(i.number::VARCHAR, 2, '0') END AS unit, i.input_id % 6 = 0 AS said_country FROM input AS i LEFT JOIN point AS p ON p.street_id = i.street_id AND p.number = i.number),
s AS (SELECT *, CASE WHEN found THEN own ELSE typed_postal END AS postal, CASE WHEN found THEN CASE WHEN blk = typed_blk THEN 'confirmed' ELSE 'replaced' END END AS ps, CASE WHEN found THEN CASE WHEN typed_postal IS NULL THEN 'inferred' WHEN typed_postal = own THEN 'confirmed' ELSE 'replaced' END END AS cs FROM r),
t AS (SELECT *, CASE WHEN NOT found THEN 'FIX' WHEN ps <> 'confirmed' OR cs <> 'confirmed' THEN 'CONFIRM' ELSE 'ACCEPT' END AS action,
  CASE WHEN found THEN 100 - CASE WHEN ps = 'replaced' THEN 30 ELSE 0 END - CASE cs WHEN 'replaced' THEN 30 WHEN 'inferred' THEN 10 ELSE 0 END ELSE 100 END AS score FROM s)"""


def _results(w):
    """Inputs with the point of their street and number, and how far it is what was typed."""
    i, k = w.input, F.col("input_id")
    wrong = F.lpad(((F.col("street_id") * 50 + F.col("number") * 3 + 1) % 1000000).cast("string"), 6, "0")
    typed = F.when(k % 6 == 4, wrong).when(~(k % 6).isin(1, 5), F.col("truth_postal"))
    p = w.point.select("street_id", "number", "point_id", F.col("blk").alias("pblk"), F.col("postal").alias("own"), "building", "lat", "lng")
    n = F.col("number").cast("string")
    r = i.join(p, ["street_id", "number"], "left").withColumns({"found": F.col("point_id").isNotNull(), "typed_blk": n, "typed_postal": typed, "road": F.col("name"), "typed_road": F.col("name")})
    found = F.col("found")
    r = r.withColumns({
        "id": k, "blk": F.coalesce("pblk", n), "postal": F.when(found, F.col("own")).otherwise(F.col("typed_postal")), "unit": F.when(k % 6 == 2, F.concat(F.lit("#05-"), F.lpad(n, 2, "0"))), "ratio": F.lit(100.0), "said_country": k % 6 == 0,
        "premise": F.when(found, F.when(F.col("pblk") == n, "confirmed").otherwise("replaced")), "route": F.lit("confirmed"), "postcode": F.when(found, F.when(F.col("typed_postal").isNull(), "inferred").when(F.col("typed_postal") == F.col("own"), "confirmed").otherwise("replaced")),
        "unresolved": F.array().cast("array<string>"),
    })
    action = F.when(~found, "FIX").when((F.col("premise") != "confirmed") | (F.col("postcode") != "confirmed"), "CONFIRM").otherwise("ACCEPT")
    return r.withColumn("action", action).withColumn("reasons", F.when(found, F.array().cast("array<string>")).otherwise(F.array(F.lit("PREMISE_NOT_FOUND"))))


@query(f"""
, {_RESULT} SELECT id, action AS next_action, score::INT AS change_score, CASE action WHEN 'ACCEPT' THEN 'A' WHEN 'CONFIRM' THEN 'C' ELSE 'F' END || CASE WHEN found THEN '4' ELSE '3' END
  || CASE WHEN found AND (ps = 'confirmed' OR cs = 'confirmed') THEN '4' ELSE '3' END || '-' || lpad(score::VARCHAR, 3, '0') AS code, CASE WHEN unit IS NOT NULL THEN 'SUB_PREMISE' ELSE 'PREMISE' END AS given, found OR typed_postal IS NOT NULL AS complete,
  NOT found OR unit IS NOT NULL AS unconfirmed, NOT said_country OR coalesce(cs = 'inferred', false) AS inferred, coalesce(ps = 'replaced' OR cs = 'replaced', false) AS replaced FROM t""")
def response_verdict(w):
    v = F.col("response.verdict")
    out = R.responses(_results(w)).select("id", v.possibleNextAction.alias("next_action"), v.changeScore.alias("change_score"), v.verificationCode.alias("code"), v.inputGranularity.alias("given"), v.addressComplete.alias("complete"), v.hasUnconfirmedComponents.alias("unconfirmed"), v.hasInferredComponents.alias("inferred"), v.hasReplacedComponents.alias("replaced"))
    return out


@query(f"""
, {_RESULT} SELECT id, blk || ' ' || {_TITLE.format("road")} || CASE WHEN unit IS NOT NULL THEN ', ' || unit ELSE '' END || CASE WHEN found AND building IS NOT NULL THEN ', ' || array_to_string(list_transform(string_split(building, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN x ELSE upper(x[1]) || lower(x[2:]) END), ' ') ELSE '' END
  || CASE WHEN postal IS NOT NULL THEN ', Singapore ' || postal ELSE '' END AS formatted,
  'street_number,route' || CASE WHEN postal IS NOT NULL THEN ',postal_code' ELSE '' END || CASE WHEN unit IS NOT NULL THEN ',subpremise' ELSE '' END || CASE WHEN found AND building IS NOT NULL THEN ',premise' ELSE '' END || ',country' AS components,
  CASE WHEN found OR typed_postal IS NOT NULL THEN '' ELSE 'postal_code' END AS missing, coalesce(found AND blk <> typed_blk, false) AS shows_typed_block FROM t""")
def response_address(w):
    a = F.col("response.address")
    kinds = F.transform(a.addressComponents, lambda c: c.componentType)
    typed = F.exists(a.addressComponents, lambda c: (c.componentType == "street_number") & c.originalText.isNotNull())
    return R.responses(_results(w)).select("id", a.formattedAddress.alias("formatted"), F.array_join(kinds, ",").alias("components"), F.array_join(a.missingComponentTypes, ",").alias("missing"), typed.alias("shows_typed_block"))


@query("SELECT point_id, CASE point_id % 3 WHEN 0 THEN 'subpremise,street_number,route,country' WHEN 1 THEN 'route,postal_code,other' ELSE 'premise,locality' END AS kinds FROM point")
def sorted_components(w):
    kinds = F.when(F.col("point_id") % 3 == 0, F.array(*(F.lit(x) for x in ("country", "route", "subpremise", "street_number")))).when(F.col("point_id") % 3 == 1, F.array(*(F.lit(x) for x in ("other", "postal_code", "route")))).otherwise(F.array(F.lit("locality"), F.lit("premise")))
    c = R.sort_components(F.transform(kinds, lambda k: F.struct(k.alias("componentType"))))
    return w.point.select("point_id", F.array_join(F.transform(c, lambda x: x.componentType), ",").alias("kinds"))


@query("SELECT point_id, CASE point_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'street_number' WHEN 2 THEN 'postal_code' ELSE 'postal_town,postal_code' END AS missing FROM point")
def required_types(w):
    k = F.col("point_id") % 4
    present = F.when(k == 1, F.array(*(F.lit(x) for x in ("route", "locality", "postal_code")))).when(k == 2, F.array(*(F.lit(x) for x in ("route", "street_number", "locality")))).when(k == 3, F.array(F.lit("premise"))).otherwise(F.array(*(F.lit(x) for x in ("route", "street_number", "locality", "postal_code"))))
    return w.point.select("point_id", F.array_join(R.required_missing(F.lit("ACZ"), F.when(k == 3, "GB").otherwise("DE"), present, k == 3), ",").alias("missing"))


@query(f"""
, x AS (SELECT point_id, blk || ' ' || {_TITLE.format("name")} AS a, CASE WHEN point_id % 2 = 0 THEN 'Town' || area_id ELSE '' END AS c, CASE point_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'State' ELSE 'TOWN' || area_id END AS s, CASE WHEN point_id % 5 = 0 THEN '' ELSE postal END AS z FROM point),
y AS (SELECT *, CASE WHEN lower(s) = lower(c) THEN '' ELSE s END AS s2 FROM x),
l AS (SELECT point_id, a, concat_ws(' ', nullif(concat_ws(', ', nullif(c, ''), nullif(s2, '')), ''), nullif(z, '')) AS b FROM y)
SELECT point_id, a || CASE WHEN b <> '' THEN ', ' || b ELSE '' END || ', Land' AS line FROM l""")
def formatted_lines(w):
    k = F.col("point_id")
    town = F.col("area_id").cast("string")
    parts = {
        "A": F.concat_ws(" ", "blk", T.title_case(F.col("name"))), "C": F.when(k % 2 == 0, F.concat(F.lit("Town"), town)).otherwise(""), "S": F.when(k % 3 == 0, "").when(k % 3 == 1, "State").otherwise(F.concat(F.lit("TOWN"), town)), "Z": F.when(k % 5 == 0, "").otherwise(F.col("postal")),
    }
    return w.point.select("point_id", R.join_lines(R.format_lines("%N%n%O%n%A%n%C, %S %Z", parts), F.lit("Land"), F.lit(False)).alias("line"))


@query("SELECT * FROM (VALUES (1, 'ar', 'CONFIRM'), (2, 'ja', 'CONFIRM'), (3, 'zh', 'ACCEPT'), (4, 'bg', 'FIX'), (5, 'kk', 'ACCEPT'), (6, 'fr', 'CONFIRM_ADD_SUBPREMISES'), (7, 'th', 'ACCEPT'), (8, 'en', 'ACCEPT')) AS t(id, language, action)", with_world=False)
def input_languages(w):
    rows = [(1, "شارع", "AE", "ar en", "CONFIRM_ADD_SUBPREMISES"), (2, "丸の内", "JP", "ja", "CONFIRM"), (3, "中山路", "SG", "en zh", "ACCEPT"), (4, "Пиротска", "BG", "bg", "FIX"), (5, "Абай", "KZ", "kk ru", "ACCEPT"), (6, "rue", "US", "ar fr", "CONFIRM_ADD_SUBPREMISES"), (7, "ถนน", "TH", "th", "ACCEPT"), (8, "road", "TH", "th", "ACCEPT")]
    df = w.spark.createDataFrame(rows, "id int, text string, country string, langs string, action string")
    return df.select("id", R.language_of(T.script_of(F.col("text")), F.col("country"), F.split("langs", " ")).alias("language"), R.next_action(F.col("action"), F.col("country")).alias("action"))


@query("""
, x AS (SELECT street_id, string_split(name, ' ')[1] AS a, string_split(name, ' ')[2] AS b FROM street)
SELECT street_id, CASE street_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'part' WHEN 2 THEN 'same' ELSE '' END AS relation, upper(a[1]) || lower(a[2:]) || '-' || upper(b[1]) || lower(b[2:]) AS title, CASE WHEN street_id % 2 = 0 THEN b ELSE a END AS one, CASE WHEN street_id % 3 = 0 THEN b ELSE 'ถนน' END AS picked FROM x""")
def place_names(w):
    words = F.split("name", " ")
    a, b, k = words[0], words[1], F.col("street_id")
    other = F.when(k % 4 == 0, F.concat_ws(" ", F.lit("CITY"), a)).when(k % 4 == 1, F.concat_ws(" ", a, F.lit("9"))).when(k % 4 == 2, a).otherwise(F.concat(a, F.lit("X")))
    named = R.pick_name(F.array(F.concat(a, F.lit("Q")), b, F.lit("ถนน")), F.lit("thai"), F.when(k % 3 == 0, F.concat_ws(" ", F.lit("12"), b)).otherwise("12"))
    return w.street.select("street_id", R.place_relation(a, other, ["CITY"]).alias("relation"), R.title(F.concat_ws("-", a, b)).alias("title"), R.one_language(F.concat_ws(" - ", a, b), k % 2 == 0).alias("one"), named.alias("picked"))


@query(f"""
, c AS (SELECT place_id AS city_id, lat AS clat, lng AS clng, population * 20 AS population, CASE WHEN population * 20 >= 1000000 THEN 1.5 ELSE 1.0 END * least(30000.0, greatest(8000.0, 8000 + 4000 * log10(greatest(population * 20, 1) / 1000.0))) AS reach FROM place WHERE population * 20 >= 50000)
SELECT s.street_id AS id, arg_max(city_id, (population, -city_id)) AS city_id FROM street AS s JOIN c ON {_HAVERSINE.format(a="s.", b="c")} <= reach GROUP BY 1""")
def containing_city(w):
    c = w.place.select(F.col("place_id").alias("city_id"), F.col("lat").alias("clat"), F.col("lng").alias("clng"), (F.col("population") * 20).alias("population"))
    return R.city_of(w.street.select(F.col("street_id").alias("id"), "lat", "lng"), c, 0.42)


@query("""
SELECT point_id AS id, CASE WHEN substr(postal, 1, 2) = '01' THEN 'N' WHEN substr(postal, 1, 1) = '0' THEN 'E' WHEN substr(postal, 1, 1) = '1' THEN 'S' END AS state FROM point WHERE substr(postal, 1, 1) IN ('0', '1')""")
def state_by_postcode(w):
    prefixes = w.spark.createDataFrame([("SG", "0", "E"), ("SG", "01", "N"), ("SG", "1", "S"), ("SG", "2", "A"), ("SG", "2", "B"), ("MY", "3", "M")], "market string, prefix string, state string")
    return R.subdivision_by_postcode(w.point.select(F.col("point_id").alias("id"), F.lit("SG").alias("market"), F.col("postal").alias("postcode")), prefixes)


@query("SELECT street_id AS id, CASE street_id % 3 WHEN 0 THEN 'NSW' ELSE 'WA' END AS state FROM street WHERE street_id % 3 < 2")
def state_in_text(w):
    k = F.col("street_id")
    text = F.when(k % 3 == 0, F.concat(F.col("name"), F.lit(", SYDNEY, NEW SOUTH WALES"))).when(k % 3 == 1, F.concat(F.col("name"), F.lit(", PERTH WESTERN AUSTRALIA 6000"))).otherwise(F.lit("VICTORIA ROAD, SOUTH"))
    names = w.spark.createDataFrame([("NSW", "NEW SOUTH WALES"), ("WA", "WESTERN AUSTRALIA"), ("VIC", "VICTORIA")], "state string, name string")
    return R.subdivision_in_text(w.street.select(k.alias("id"), text.alias("text")), names)


@query("SELECT input_id AS id, CASE input_id % 3 WHEN 0 THEN 'sg:' || text WHEN 1 THEN 'my:' || text ELSE 'UNSUPPORTED_REGION' END AS answer FROM input")
def routed_requests(w):
    k = F.col("input_id")
    r = w.input.select(k.alias("id"), F.when(k % 3 == 0, "sg").when(k % 3 == 1, "MY").when(k % 2 == 0, "XX").alias("region"), "text")
    engine = lambda name: lambda df: df.select("id", F.concat(F.lit(f"{name}:"), "text").alias("answer"))
    return R.route_markets(r, {"SG": engine("sg"), "MY": engine("my")})
