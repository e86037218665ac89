"""City-state addresses against a small reference table: action, address, first reason."""

import pytest

from postmark.operators import parsing, resolve

ROWS = [
    ("10", "BAYFRONT AVENUE", "018956", ""), ("1", "BAYFRONT AVENUE", "018971", "THE SHOPPES|MARINA BAY SANDS"), ("1", "RAFFLES PLACE", "048616", "ONE RAFFLES PLACE"), ("34A", "POOLE ROAD", "437543", ""),
    ("12", "OXLEY ROAD", "238614", ""), ("7", "NORTH CANAL ROAD", "048821", ""), ("7B", "NORTH CANAL ROAD", "048822", ""), ("201", "TAMPINES AVENUE 7", "520201", ""), ("203", "TAMPINES AVENUE 7", "520203", ""),
    ("1", "SAINT GEORGE'S ROAD", "321001", ""), ("2", "SAINT GEORGE'S ROAD", "322002", ""), ("123", "ANG MO KIO AVENUE 3", "560123", ""), ("5", "CHANGI COAST ROAD", "819643", ""), ("8", "OXLEY ROAD", "238999", "NIL"),
]
CASES = [
    ("10 Bayfront Avenue, Singapore 018956", "ACCEPT", "10 BAYFRONT AVENUE 018956", None),
    ("018956 10 bayfront ave s'pore", "ACCEPT", "10 BAYFRONT AVENUE 018956", None),
    ("10 Bayfrnt Avenue 018956", "CONFIRM", "10 BAYFRONT AVENUE 018956", "STREET_SPELL_CORRECTED"),
    ("1 Raffles Place", "CONFIRM", "1 RAFFLES PLACE 048616", "POSTCODE_INFERRED"),
    ("10 Bayfront Avenue, Singapore 819643", "CONFIRM", "10 BAYFRONT AVENUE 018956", "POSTCODE_STREET_MISMATCH"),
    ("999 Bayfront Avenue", "FIX", None, "PREMISE_NOT_FOUND"),
    ("Marina Bay Sands", "CONFIRM", "1 BAYFRONT AVENUE 018971", "BUILDING_NAME_ONLY"),
    ("Singapore 018956", "CONFIRM", "10 BAYFRONT AVENUE 018956", "POSTCODE_ONLY"),
    ("St George's Rd", "FIX", None, "MISSING_PREMISE"),
    ("7B North Canal Road 048821", "FIX", None, "POSTCODE_BLOCK_CONFLICT"),
    ("Tampines Avenue 7, Singapore", "FIX", None, "MISSING_PREMISE"),
    ("34A Poxle Road", "CONFIRM", "34A POOLE ROAD 437543", "STREET_SPELL_CORRECTED"),
    ("10 Bayfront Ave 18956", "ACCEPT", "10 BAYFRONT AVENUE 018956", "POSTCODE_LEADING_ZERO_RESTORED"),
    ("Blk 123 Ang Mo Kio Ave 3 #5-12 560123", "ACCEPT", "123 ANG MO KIO AVENUE 3 560123", None),
    ("AMK Ave 3 Blk 123 S(560123)", "CONFIRM_ADD_SUBPREMISES", "123 ANG MO KIO AVENUE 3 560123", "UNIT_MISSING_MULTI_UNIT_BUILDING"),
    ("10 Bayfront Avenue 999999", "CONFIRM", "10 BAYFRONT AVENUE 018956", "POSTCODE_NOT_FOUND"),
    ("7 North Canal Road", "CONFIRM", "7 NORTH CANAL ROAD 048821", "POSTCODE_INFERRED"),
    ("nothing known here", "FIX", None, "NO_MATCH"), ("", "FIX", None, "NO_MATCH"), (None, "FIX", None, "NO_MATCH"),
]


@pytest.fixture(scope="module")
def entities(spark):
    rows = spark.createDataFrame([(*r, 1.0, 103.0) for r in ROWS], "blk string, road string, postal string, buildings string, lat double, lng double")
    return resolve.reference(rows).cache()


@pytest.fixture(scope="module")
def results(spark, entities):
    inputs = spark.createDataFrame(list(enumerate(c[0] for c in CASES)), "id long, text string")
    return {r["id"]: r for r in resolve.validate(inputs, entities).collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=[str(c[0]) for c in CASES])
def test_cases(results, k):
    text, action, address, reason = CASES[k]
    got = results[k]
    assert (got["action"], got["address"]) == (action, address), got
    assert reason in got["reasons"] if reason else got["reasons"] == [], got


def test_every_row_is_kept(results):
    assert len(results) == len(CASES)


def test_strictness_and_floors(spark, entities):
    inputs = spark.createDataFrame([(1, "1 Raffles Place"), (2, "10 Bayfront Avenue #80-01 018956")], "id long, text string")
    floors = spark.createDataFrame([("018956", 57)], "postal string, max_floor int")
    got = {r["id"]: r for r in resolve.validate(inputs, entities, floors, strictness="LENIENT").collect()}
    assert got[1]["action"] == "ACCEPT"
    assert got[2]["action"] == "FIX" and "UNIT_FLOOR_EXCEEDS_BUILDING" in got[2]["reasons"]


@pytest.mark.parametrize(
    ("text", "floor", "unit", "postal", "marked"),
    [
        ("Blk 123 Ang Mo Kio Ave 3 #5-12", "05", "12", None, "123"), ("10 Bayfront Ave 18956", None, None, "018956", None), ("Level 5 Unit 12, 1 Raffles Place", "05", "12", None, None),
        ("1 Raffles Place 3/F", "03", None, None, None), ("#03-05/06 1 Raffles Place S(048616)", "03", "05", "048616", None), ("#ABC 1 Raffles Place", None, None, None, None),
    ],
)
def test_parse(spark, text, floor, unit, postal, marked):
    got = parsing.parse(spark.createDataFrame([(text,)], "text string")).first()
    assert (got["unit_floor"], got["unit_no"], got["postal"], got["block_marked"]) == (floor, unit, postal, marked)


def test_repeated_rows_keep_apart(spark, entities):
    inputs = spark.createDataFrame([(1, "1 Raffles Place"), (1, "10 Bayfront Avenue 018956"), (2, "1 Raffles Place"), (2, "1 Raffles Place")], "id long, text string")
    got = sorted((r["id"], r["address"]) for r in resolve.validate(inputs, entities).collect())
    assert got == [(1, "1 RAFFLES PLACE 048616"), (1, "10 BAYFRONT AVENUE 018956"), (2, "1 RAFFLES PLACE 048616"), (2, "1 RAFFLES PLACE 048616")]


def test_repeated_reference_rows_are_one_entity(spark):
    rows = spark.createDataFrame([("1", "RED ROAD", "100000", "A", 1.0, 103.0), ("1", "Red Road", "100000", "B|A", 1.0, 103.0)], "blk string, road string, postal string, buildings string, lat double, lng double")
    assert [r["buildings"] for r in resolve.reference(rows).collect()] == [["A", "B"]]


@pytest.mark.parametrize(
    ("text", "floor", "unit", "postal"),
    [("Level 5 Unit 12 Red Road", "05", "12", None), ("Unit 3-07 Red Road", "03", "07", None), ("#B1-02/03 Red Road", "B1", "02", None), ("Red Road 05-123", "05", "123", None), ("12/F Red Road", "12", None, None), ("#3rd floor Red Road", "03", None, None), ("Red Road S(123456)", None, None, "123456"), ("Republic of Singapore 12345", None, None, "012345")],
)
def test_units_and_postcodes(spark, text, floor, unit, postal):
    r = parsing.parse(spark.createDataFrame([(text,)], "text string")).first()
    assert (r["unit_floor"], r["unit_no"], r["postal"]) == (floor, unit, postal)
    assert "REPUBLIC" not in [w for v in r["variants"] for w in v]


def test_readings_and_ranks_carry_no_lists_of_entities(spark, monkeypatch):
    """Entities of one block and road, or of one postcode, grow with the reference: steps keep counts of them and the first few ids."""
    kept = []
    monkeypatch.setattr(resolve, "cut", lambda df: kept.append(df.schema.simpleString()) or df.localCheckpoint())
    rows = [("5", "RED ROAD", f"{100000 + k}", "", 1.0, 103.0) for k in range(40)]
    entities = resolve.reference(spark.createDataFrame(rows, "blk string, road string, postal string, buildings string, lat double, lng double"))
    got = resolve.validate(spark.createDataFrame([(1, "5 Red Road"), (2, "5 Red Road 100007")], "id long, text string"), entities).collect()
    assert {r["id"]: (r["address"], len(r["candidates"])) for r in got} == {1: (None, 5), 2: ("5 RED ROAD 100007", 0)}
    assert kept and not [s for s in kept if "postal:string,buildings:array<string>>>" in s]


def test_a_word_is_read_once():
    from postmark.functions import text as T

    said = str(T.match_key("road")._jc)
    assert said.count("AVENUE:AVE") <= 3, said.count("AVENUE:AVE")


def test_names_pick_among_entities_of_one_key(spark):
    rows = [("5", "RED ROAD", "100001", "ALPHA PLAZA"), ("5", "RED ROAD", "100002", "BETA PLAZA"), ("5", "RED ROAD", "100003", "BETA PLAZA"), ("6A", "RED ROAD", "100004", "")]
    entities = resolve.reference(spark.createDataFrame([(*r, 1.0, 103.0) for r in rows], "blk string, road string, postal string, buildings string, lat double, lng double"))
    texts = ["5 Red Road Alpha Plaza", "5 Red Road Beta Plaza", "Red Road 5", "Blk 5 Red Road", "6 Red Road 100004", "100003", "Red Road Blk 5 100002"]
    got = {r["id"]: r for r in resolve.validate(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), entities).collect()}
    shown = [got[k]["address"] for k in range(len(texts))]
    assert shown == ["5 RED ROAD 100001", None, None, None, "6A RED ROAD 100004", "5 RED ROAD 100003", "5 RED ROAD 100002"]
    assert [len(got[k]["candidates"]) for k in range(len(texts))] == [0, 3, 3, 3, 0, 0, 0]
