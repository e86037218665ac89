import pytest
from pyspark.sql import functions as F

from postmark.functions import international as I


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "folded"), [("Straße", "STRASSE"), ("Łódź", "LODZ"), ("Ærø", "AERO"), ("１２３ Café", "123 CAFE"), ("٣٤", "34"), ("O'Connell St", "OCONNELL ST"), ("'quoted'", "'QUOTED'"), ("", ""), (None, None)])
def test_fold(spark, raw, folded):
    assert I.fold_text(raw) == folded
    assert I.fold(spark.createDataFrame([(raw,)], "t string"), "t").first()["t"] == folded


@pytest.mark.parametrize(
    ("code", "market", "norm", "local"),
    [("LT-01120", "LT", "01120", "LT-01120"), ("L-2348", "LU", "2348", "L-2348"), ("〒104-0028", "JP", "1040028", "104-0028"), ("01310-100", "BR", "01310100", "01310-100"), ("sw1a 1aa", "GB", "SW1A1AA", "SW1A 1AA"), ("C1043AAZ", "AR", "1043", "1043"), (None, "DE", "", ""), ("m5v2k4", "CA", "M5V2K4", "M5V 2K4"), ("D-10115", "DE", "10115", "10115")],
)
def test_postcodes(spark, code, market, norm, local):
    got = I.norm_postcode(F.lit(code).cast("string"), F.lit(market))
    assert (one(spark, got), one(spark, I.local_postcode(got, F.lit(market)))) == (norm, local)


@pytest.mark.parametrize(("number", "country", "want"), [("41-43", "DE", ["41-43", "41", "43"]), ("15a/4", "PL", ["15A/4", "15A"]), ("12/3", "CZ", ["12/3", "12", "3"]), ("7 B", "SG", ["7B"]), ("5-5", "DE", ["5-5", "5"])])
def test_numbers(spark, number, country, want):
    assert one(spark, I.number_spellings(F.lit(number), F.lit(country))) == want


def test_towns(spark):
    assert one(spark, I.locality_key(F.lit("Oldenburg (Oldenb.), Stadt"))) == "OLDENBURG"
