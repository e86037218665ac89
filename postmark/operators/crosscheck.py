"""Holding a geocoder's answer against the text and the reference: street names, homonyms elsewhere, pilot areas, postcodes' places."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postmark.functions import geo
from postmark.functions.similarity import ratio

#: Words that stand before the number of a numbered street, and their kind.
NUMBERED = {"STREET": "ST", "ST": "ST", "STR": "ST", "ROAD": "RD", "RD": "RD", "AVENUE": "AV", "AVE": "AV", "AV": "AV", "CALLE": "CL", "CL": "CL", "CLL": "CL"}
#: Metres between which another street of a numbered one's name is its twin, and beyond which it is elsewhere.
TWIN_M, ELSEWHERE_M = (300, 5000), 2000


def numbered_streets(words: list[str]) -> set[tuple[str, str]]:
    """(kind, number) of each numbered street that the words name."""
    rest = [w for w in words if w not in ("NO", "NUMBER", "NR")]
    return {(NUMBERED[a], b) for a, b in zip(rest, rest[1:], strict=False) if a in NUMBERED and b[:1].isdigit() and b.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ").isdigit()}


def counterpart(word: str, others: list[str]) -> float:
    """2 where the word is among the others, 1 where one of them is close to it or one is short for the other, else 0."""
    if word in others:
        return 2

    def alike(x: str) -> bool:
        short, long = sorted((word, x), key=len)
        if len(short) >= 3 and long.startswith(short) and 2 * len(short) >= len(long):
            return True
        return len(short) >= 4 and len(long) - len(short) <= 4 and ratio(word, x) >= 80

    return 1 if any(map(alike, others)) else 0


def compare_routes(answer: list[str], written: list[str], kinds: set[str]) -> str:
    """CONFIRMED, CORRECTED, CONFLICT or INFERRED (nothing to compare with): a geocoder's street against the words of the written one, both without house numbers."""
    name = lambda ws: [w for w in ws if w not in kinds and len(w) >= 2 and not any(c.isdigit() for c in w)]
    a, b = name(answer), name(written)
    numbers = [w for w in answer if any(c.isdigit() for c in w)]
    if not set(numbers) <= set(written):
        return "CONFLICT"
    if not a:
        mine, theirs = numbered_streets(answer), numbered_streets(written)
        if not numbers:
            return "INFERRED"
        if not mine or not theirs or mine <= theirs:
            return "CONFIRMED"
        return "CORRECTED" if {n for _, n in mine - theirs} <= {n for _, n in theirs} else "CONFLICT"
    if not b:
        return "INFERRED"
    ours, others = [counterpart(w, b) for w in a], [counterpart(w, a) for w in b]
    share = lambda hits: sum(h > 0 for h in hits) / len(hits)
    if share(ours) == 1 or (share(others) == 1 and share(ours) >= 0.5):
        return "CORRECTED" if 1 in ours + others else "CONFIRMED"
    return "CORRECTED" if share(ours) >= 1 / 3 and share(others) >= 0.5 else "CONFLICT"


def route_match(kinds: list[str]):
    """A function of two text Columns (answer, written) that gives ``compare_routes``; null where one is null."""
    types = frozenset(kinds)

    @F.pandas_udf(StringType())
    def run(answer: pd.Series, written: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else compare_routes(a.split(), b.split(), types) for a, b in zip(answer, written, strict=True)], dtype=object)

    return run


def combine(by_reference: Column, by_text: Column) -> Column:
    """One verdict of two: what the reference confirms is at most corrected by the text, and the other way round; the text decides where the reference says nothing."""
    table = {
        "CONFIRMED": {"CONFLICT": "CORRECTED", "": "CONFIRMED"}, "CORRECTED": {"CONFIRMED": "CONFIRMED", "": "CORRECTED"}, "CONFLICT": {"CONFIRMED": "CORRECTED", "CORRECTED": "CORRECTED", "": "CONFLICT"},
    }
    out = by_text
    for mine, answers in table.items():
        merged = F.lit(answers[""])
        for theirs, said in answers.items():
            if theirs:
                merged = F.when(by_text == theirs, said).otherwise(merged)
        out = F.when(by_reference == mine, merged).otherwise(out)
    return out


def homonyms_near(answers: DataFrame, streets: DataFrame) -> DataFrame:
    """Adds ``twin``: whether another street of the answer's key lies within the twin distances. ``streets`` (street_id, key, slat, slng)."""
    places = streets.select("key", "slat", "slng").distinct()
    return _flag(answers, places, ["key"], "twin", lambda m: (m > TWIN_M[0]) & (m <= TWIN_M[1]))


def elsewhere(answers: DataFrame, streets: DataFrame, points: DataFrame) -> DataFrame:
    """Adds ``elsewhere``: whether a street of the answer's key farther off has its number, too. ``points`` (street_id, nkey)."""
    places = streets.join(points.select("street_id", "nkey").distinct(), "street_id").select("key", "nkey", "slat", "slng").distinct()
    return _flag(answers, places, ["key", "nkey"], "elsewhere", lambda m: m > ELSEWHERE_M)


def _flag(answers: DataFrame, places: DataFrame, by: list[str], name: str, holds) -> DataFrame:
    """Adds a flag: whether one of the ``places`` (the columns ``by``, slat, slng) holds; each distinct answer is compared once with each distinct place."""
    metres, at = geo.haversine(F.col("lat"), F.col("lng"), F.col("slat"), F.col("slng")), [*by, "lat", "lng"]
    hit = answers.select(*at).distinct().join(places, by).where(holds(metres)).select(*at).distinct().withColumn(name, F.lit(True))
    return answers.join(hit, at, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def pilot_position(lat: Column, lng: Column, population: Column, boxes: list[tuple[float, float, float, float]]) -> Column:
    """2 where a place is within one of the boxes (west, south, east, north), 1 where its built-up area reaches one, else 0."""
    clamp = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    reach = 3000.0 + 2000.0 * F.log10(F.greatest(population, F.lit(1000)) / 1000)
    inside = reached = F.lit(False)
    for west, south, east, north in boxes:
        inside = inside | (lat.between(south, north) & lng.between(west, east))
        reached = reached | (geo.haversine(lat, lng, clamp(lat, south, north), clamp(lng, west, east)) <= reach)
    return F.when(inside, 2).when(reached, 1).otherwise(0)


def postcode_place(codes: DataFrame, places: DataFrame, lengths: tuple[int, ...] = (4, 3)) -> DataFrame:
    """(id, place): a code's place (market, postcode, place), else that of a shorter form: a whole town's code, the outward part, the longest prefix, as the market has them."""
    pc, market = F.col("postcode"), F.col("market")
    forms = [pc, F.when((market == "BR") & (F.length(pc) == 8), F.concat(F.substring(pc, 1, 5), F.lit("000"))), F.when((market == "GB") & (F.length(pc) >= 5), F.substring(pc, F.lit(1), F.length(pc) - 3))]
    forms += [F.when(market.isin("CA", "IE", "NL") & (F.length(pc) > n), F.substring(pc, 1, n)) for n in lengths]
    tried = codes.select("id", "market", F.posexplode(F.array(*forms)).alias("rank", "postcode")).where("postcode is not null")
    return tried.join(places, ["market", "postcode"]).groupBy("id").agg(F.min_by("place", F.struct("rank", "place")).alias("place"))


def free_action(verdict: Column, town_holds: Column) -> Column:
    """Without a reference table: a verified answer within its town is ACCEPT, a rejected one FIX, any other CONFIRM."""
    return F.when(verdict == "REJECTED", "FIX").when((verdict == "VERIFIED") & F.coalesce(town_holds, F.lit(False)), "ACCEPT").otherwise("CONFIRM")


def foreign(text: Column, places: list[str]) -> Column:
    """Whether a text names a foreign place, has no six-digit code, and holds a five-digit code or a foreign street form."""
    upper = F.upper(text)
    named = upper.rlike(r"\b(?:" + "|".join(places) + r")\b")
    return named & ~upper.rlike("(?<![0-9])[0-9]{6}(?![0-9])") & (upper.rlike("(?<![0-9])[0-9]{5}(?![0-9])") | upper.rlike(r"\bTAMAN\b|\bJALAN [A-Z]*[0-9]+/[0-9]+"))


def address_like(texts: DataFrame, roads: DataFrame, buildings: DataFrame) -> DataFrame:
    """Adds ``address_like``: whether a text's words hold a road's key, or are a building's name. ``texts`` (id, words), ``roads`` (key), ``buildings`` (name)."""
    from postmark.operators.recall import spans

    found = texts.select("id", F.explode(spans(F.col("words"))).alias("s")).select("id", F.col("s.span").alias("key"))
    hit = found.join(roads.select("key").distinct(), "key", "left_semi").select("id")
    whole = texts.select("id", F.array_join("words", " ").alias("name")).join(buildings.select("name").distinct(), "name", "left_semi").select("id")
    return texts.join(hit.unionByName(whole).distinct().withColumn("address_like", F.lit(True)), "id", "left").withColumn("address_like", F.coalesce("address_like", F.lit(False)))
