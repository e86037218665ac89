"""Functions and operators of the address engine on small, hand-checked cases."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmark.functions import geo, similarity, stats, text
from postmark.operators import evidence, metrics, numbers, recall, spatial


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        ("Ang Mo Kio Avenue 3", "ANG MO KIO AVE 3"), ("ang mo kio ave 3", "ANG MO KIO AVE 3"), ("AMK Ave 3", "ANG MO KIO AVE 3"), ("St George's Rd", "ST GEORGES RD"), ("Blk123 Ave3", "BLK 123 AVE 3"),
        ("Bedok N Ave 3", "BEDOK NTH AVE 3"), ("188-2B Road, (x)", "188-2B RD X"), ("JW St 41", "JURONG WEST ST 41"), ("JW Tower", "JW TWR"), ("", ""), ("W Coast Dr", "WEST COAST DR"), ("Tampines # 5 - a", "TAMPINES 5 A"),
    ],
)
def test_match_key(spark, raw, key):
    assert one(spark, text.match_key(F.lit(raw))) == key


def test_compatibility_forms(spark):
    df = text.fold_compatibility(spark.createDataFrame([("１０ Ｂａｙ",), (None,)], "t string"), "t")
    assert [r[0] for r in df.select(text.clean_text("t")).collect()] == ["10 BAY", ""]


def test_parts_and_titles(spark):
    key = F.lit("ANG MO KIO AVE 3A 5")
    assert one(spark, text.alpha_part(key)) == "ANG MO KIO AVE"
    assert one(spark, text.number_part(key)) == ["3A", "5"]
    assert one(spark, text.title_case(F.lit("BLK 11A POOLE  road"))) == "Blk 11A Poole Road"
    assert one(spark, text.number_key(F.lit(" 12 a "))) == "12A"


@pytest.mark.parametrize(("blk", "postal", "is_it"), [("123", "560123", True), ("123", "561123", False), ("516A", "521516", True), ("516B", "521516", False), ("1", "018001", False), ("1", "010001", True), ("12-3", "560123", False)])
def test_public_housing(spark, blk, postal, is_it):
    assert one(spark, text.is_public_housing(F.lit(blk), F.lit(postal))) is is_it


def test_ratios():
    assert similarity.ratio("BAYFRNT AVE", "BAYFRONT AVE") == pytest.approx(95.652, abs=1e-3)
    assert similarity.ratio("POXLE RD", "POOLE RD") == similarity.ratio("POXLE RD", "OXLEY RD") == 87.5
    assert similarity.token_sort("B A", "A B") == 100
    assert similarity.token_set("MARINA BAY", "MARINA BAY SANDS") == 100
    assert similarity.partial("BAY", "MARINA BAY SANDS") == 100
    assert similarity.ratio("", "") == 100 and similarity.token_set("", "A") == 0


@given(st.text("ABC ", max_size=12), st.text("ABC ", max_size=12))
def test_common_subsequence_is_exact(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    assert similarity.lcs(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_ratio_columns(spark):
    df = spark.createDataFrame([("AB", "AB"), (None, "A")], "a string, b string")
    assert [r[0] for r in df.select(similarity.indel_ratio("a", "b")).collect()] == [100.0, None]


def test_geography(spark):
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(math.pi * geo.EARTH_M / 180)
    assert one(spark, geo.encode_plus_code(F.lit(47.365590), F.lit(8.524997))) == "8FVC9G8F+6X"
    p = one(spark, geo.decode_plus_code(F.lit("8FVC9G8F+6X")))
    assert (p["lat"], p["lng"]) == (pytest.approx(47.365562), pytest.approx(8.524938, abs=1e-5))
    assert one(spark, geo.decode_plus_code(F.lit("nonsense"))) is None
    assert one(spark, geo.town_radius(F.lit(10_000))) == 12_000
    ring = F.array(*(F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lng")) for y, x in ((0, 0), (0, 4), (4, 0), (0, 0))))
    assert one(spark, spatial.inside(F.lit(1.0), F.lit(1.0), ring)) is True
    assert one(spark, spatial.inside(F.lit(3.0), F.lit(3.0), ring)) is False


def test_wilson(spark):
    assert one(spark, stats.wilson_lower(F.lit(95), F.lit(100))) == pytest.approx(0.8882, abs=1e-3)
    assert one(spark, stats.wilson_lower(F.lit(0), F.lit(0))) == 0


def test_recall(spark):
    got = one(spark, recall.spans(F.split(F.lit("A B C"), " "), 2))
    assert [r["span"] for r in got] == ["A", "A B", "B", "B C", "C"]
    words = spark.createDataFrame([("BAYFRNT",), ("POXLE",), ("ZZZZ",)], "word string")
    vocabulary = spark.createDataFrame([("BAYFRONT", 3), ("POOLE", 5), ("OXLEY", 5)], "word string, freq int")
    assert {r["word"]: r["fixed"] for r in recall.nearest_words(words, vocabulary).collect()} == {"BAYFRNT": "BAYFRONT", "POXLE": "POOLE"}
    keys = spark.createDataFrame([("POOLE RD",), ("OXLEY RD",)], "key string")
    top = recall.trigram_candidates(spark.createDataFrame([("POXLE RD",)], "query string"), keys, top=1).collect()
    assert [r["key"] for r in top] == ["POOLE RD"] or [r["key"] for r in top] == ["OXLEY RD"]


def test_numbers(spark):
    points = spark.createDataFrame([(1, 10, 1.0, 1.0), (1, 14, 2.0, 3.0), (1, 13, 9.0, 9.0)], "street_id long, number int, lat double, lng double")
    probes = spark.createDataFrame([(7, 1, 12), (8, 2, 12), (9, 1, 16)], "id long, street_id long, number int")
    assert {(r["id"], r["found"]) for r in numbers.nearest_number(probes, points).collect()} == {(7, 14), (9, 14)}
    assert [(r["id"], r["lat"], r["lng"]) for r in numbers.interpolate(probes, points).collect()] == [(7, 1.5, 2.0)]


def test_posterior_sums_to_one(spark):
    ev = spark.createDataFrame([(1, "a", 5.0), (1, "b", 1.0), (2, "c", -900.0)], "id int, c string, evidence double")
    rows = evidence.posterior(ev, "id", prior_none=0.2).collect()
    total = {k: sum(r["posterior"] for r in rows if r["id"] == k) for k in (1, 2)}
    none = 0.2 / (0.2 + 0.4 * 2**5 + 0.4 * 2)
    assert total[1] == pytest.approx(1 - none) and total[2] == pytest.approx(0)


def test_confidence_backs_off(spark):
    rows = spark.createDataFrame([("x", "c", 1)] * 30 + [("y", "c", 0)], "fine string, coarse string, ok int")
    got = {r["fine"]: r["confidence"] for r in evidence.shrunk_confidence(rows, ["fine", "coarse"], "ok").collect()}
    base = 31 / 33
    assert got["x"] == pytest.approx((30 + 10 * base) / 40) and got["y"] == pytest.approx(10 * base / 11)


def test_metrics(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, y int")
    assert metrics.auroc(rows, "p", "y").first()[0] == 0.75
    assert metrics.calibration(rows, "p", "y").first()["brier"] == pytest.approx((0.01 + 0.16 + 0.4225 + 0.04) / 4)


def test_within_reaches_far_north(spark):
    from postmark.operators import spatial

    left = spark.createDataFrame([(1, 60.0, 10.0)], "id int, lat double, lng double")
    right = spark.createDataFrame([(1, 60.0, 10.0139), (2, 60.0, 10.03), (3, 60.0, 9.9862)], "rid int, rlat double, rlng double")
    assert {r["rid"] for r in spatial.within(left, right, 800, 0.01).collect()} == {1, 3}
    with pytest.raises(ValueError):
        spatial.within(left, right, 2000, 0.01)


def test_short_plus_codes_are_recovered(spark):
    df = spark.createDataFrame([("C5RC+6Q", 1.30, 103.83), ("8FVC9G8F+6W", 0.0, 0.0), ("9G8F+6W", 47.4, 8.6), ("none", 1.0, 1.0)], "code string, lat double, lng double")
    got = [r[0] for r in df.select(geo.recover_plus_code(F.col("code"), F.col("lat"), F.col("lng"))).collect()]
    assert got[1] == "8FVC9G8F+6W" and got[2] == "8FVC9G8F+6W" and got[0].endswith("C5RC+6Q") and got[3] is None


@pytest.mark.parametrize(("how", "ratio", "want"), [("exact", 100.0, 3.0), ("suffix", 100.0, 2.3), ("partial", 100.0, 2.2), ("fuzzy", 86.0, 1.0), ("fuzzy", 100.0, 2.2)])
def test_base_score(spark, how, ratio, want):
    from postmark.operators import scoring

    assert one(spark, scoring.base_score(F.lit(how), F.lit(ratio))) == pytest.approx(want)
