"""Sources, batches, the stream wrapper, noise and cross-checks on small cases."""

import pytest
from pyspark.sql import functions as F

from postmark.operators import geocoder, noise, resolve
from postmark.sources import tables
from postmark.streaming.validate import validate_stream

ROWS = [("10", "BAYFRONT AVENUE", "018956", "", 1.0, 103.0), ("1", "RAFFLES PLACE", "048616", "ONE RAFFLES PLACE|NIL", 1.1, 103.1), ("NIL", "X ROAD", "000001", "", 0.0, 0.0)]


@pytest.fixture(scope="module")
def entities(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ref") / "ref")
    tables.write_reference(spark.createDataFrame(ROWS, tables.REFERENCE), path)
    return tables.read_reference(spark, path).cache()


def test_reference_round_trip(entities):
    got = {r["postal"]: r for r in entities.collect()}
    assert set(got) == {"018956", "048616"}  # leading zeros survive, NIL blocks don't
    assert got["048616"]["buildings"] == ["ONE RAFFLES PLACE"] and got["018956"]["road_key"] == "BAYFRONT AVE"


def test_dump(spark):
    rows = [("1", "A RD", "123456", "NIL", "1.5", "103.5"), ("1", "A RD", "123456", "TWR", "1.5", "103.5"), ("NIL", "A RD", "123456", "", "1", "1"), ("2", "A RD", "12345", "", "1", "1")]
    got = tables.entities_of_dump(spark.createDataFrame(rows, "BLK_NO string, ROAD_NAME string, POSTAL string, BUILDING string, LATITUDE string, LONGITUDE string")).collect()
    assert [tuple(r) for r in got] == [("1", "A RD", "123456", "TWR", 1.5, 103.5)]


def test_gazetteer(spark, tmp_path):
    row = lambda i, name, cls, code, pop: "\t".join([str(i), name, name, "Alt One,X1,ABC", "1.0", "2.0", cls, code, "SG", "", "01", "", "", "", str(pop), "", "", "", ""])
    (tmp_path / "g.tsv").write_text("\n".join([row(1, "Town", "P", "PPL", 500), row(2, "Old", "P", "PPLH", 5), row(3, "State", "A", "ADM1", 0), row(4, "Hill", "T", "HLL", 0), row(5, "Town", "P", "PPLX", 900)]))
    got = tables.read_gazetteer(spark, str(tmp_path / "g.tsv"))
    assert {(r["id"], r["kind"]) for r in got.collect()} == {(1, "P"), (3, "A1"), (5, "X")}
    top = tables.gazetteer_names(got, most=1).where("name = 'TOWN'").collect()
    assert [r["id"] for r in top] == [5]


def test_batch_keeps_every_row(spark, entities):
    rows = spark.createDataFrame([("a", "10 Bayfront Avenue 018956", "SG"), ("b", "x", "FR"), ("c", " ", None), ("a", "10 Bayfront Avenue 018956", "sg")], "who string, text string, region string")
    got = sorted((r["who"], r["av_action"] or "", r["av_error"] or "", r["av_address"] or "") for r in tables.validate_batch(rows, entities).collect())
    ok = ("a", "ACCEPT", "", "10 BAYFRONT AVENUE 018956")
    assert got == [ok, ok, ("b", "", "unsupported region: FR", ""), ("c", "", "empty text", "")]


def test_stream(spark, entities, tmp_path):
    spark.createDataFrame([(1, "1 Raffles Place 048616")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    validate_stream(stream, entities, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    assert [r["action"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["ACCEPT"]


def test_noise(spark):
    rows = [(1, "Attn: Mr Lee, 10 Bayfront Avenue 018956, call 91234567, a.b@c.example.com"), (2, "ACME PTE LTD, 1 Raffles Place; please leave at door"), (3, None), (4, "Mr Bean Cafe, order no: AB12345678")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r for r in noise.separate(df).collect()}
    assert got[1]["clean"] == "10 Bayfront Avenue 018956" and got[1]["recipients"] == ["Mr Lee"] and got[1]["emails"] == ["a.b@c.example.com"] and got[1]["phones"] == ["call 91234567"]
    assert got[2]["clean"] == "1 Raffles Place" and got[2]["companies"] == ["ACME PTE LTD"] and got[2]["notes"] == ["please leave at door"]
    assert got[3]["clean"] == "" and got[4]["orders"] == ["order no: AB12345678"] and got[4]["recipients"] == ["Bean Cafe"]
    known = spark.createDataFrame([("MR BEAN CAFE",)], "segment string")
    kept = {r["id"]: r["clean"] for r in noise.separate(df, known=known).collect()}
    assert kept[4] == "Mr Bean Cafe" and kept[3] == ""


@pytest.mark.parametrize(
    ("metres", "number", "postal", "route", "want"),
    [(100.0, "CONFIRMED", "CONFIRMED", "CONFIRMED", "VERIFIED"), (100.0, "CONFLICT", "CONFIRMED", "CONFIRMED", "PLAUSIBLE"), (600.0, "CONFIRMED", "CONFIRMED", "CONFIRMED", "PLAUSIBLE"), (600.0, "CONFIRMED", "CONFLICT", "CONFIRMED", "REJECTED"), (100.0, None, "CONFIRMED", "CONFIRMED", "MISSING_NUMBER"), (2500.0, "CONFIRMED", "CONFIRMED", "CONFIRMED", "REJECTED"), (100.0, None, "CONFIRMED", "CORRECTED", "STREET_LEVEL")],
)
def test_verdicts(spark, metres, number, postal, route, want):
    side = lambda x: F.lit(x).cast("string")
    assert spark.range(1).select(geocoder.verdict(F.lit(metres), side(number), side(postal), side(route))).first()[0] == want
