"""Resolving city-state addresses: hypotheses from blocks and roads, ranking by corroboration, decision, reasons.

``validate`` keeps every input row. Recall is a set of equi-joins (postcode, block with road, road spans, misspelt
roads through shared bigrams); a hypothesis is a row, and the best of an input is taken by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmark.functions import similarity
from postmark.functions import text as T
from postmark.operators import parsing, recall
from postmark.operators.lineage import cut

_ENTITY = ("eid", "blk", "road", "road_key", "postal", "buildings")


def reference(rows: DataFrame) -> DataFrame:
    """Entities from (blk, road, postal, buildings separated by |, lat, lng): keys made, blanks and NIL dropped.

    Rows that repeat (blk, road, postal) are one entity with the buildings of all; its id is a hash of the three.
    """
    blk, road = F.upper(F.trim("blk")), F.upper(F.trim("road"))
    e = rows.where("blk is not null and road is not null and upper(trim(blk)) <> 'NIL' and upper(trim(road)) <> 'NIL' and trim(blk) <> '' and trim(road) <> ''")
    e = e.select(blk.alias("blk"), road.alias("road"), F.trim("postal").alias("postal"), F.filter(F.split(F.coalesce("buildings", F.lit("")), r"\|"), lambda b: (b != "") & (b != "NIL")).alias("buildings"), "lat", "lng")
    e = e.groupBy("blk", "road", "postal").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("buildings")))).alias("buildings"), F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    return T.with_key(e.withColumn("eid", F.xxhash64("blk", "road", "postal")), "road", "road_key")


def _buildings(entities: DataFrame) -> DataFrame:
    """(eid, blk, road_key, b): the key of each building of each entity."""
    return T.with_key(entities.select("eid", "blk", "road_key", F.explode("buildings").alias("__b")), "__b", "b").drop("__b").distinct()


def _groups(entities: DataFrame, name: str, *keys: str) -> DataFrame:
    """The entities of each key: how many (``name`` with _n) and the ids of the first five (with _five)."""
    return entities.groupBy(*keys).agg(F.count("*").alias(f"{name}_n"), F.slice(F.array_sort(F.collect_list("eid")), 1, 5).alias(f"{name}_five"))


def _roads(spans: DataFrame, entities: DataFrame, fuzzy: bool) -> DataFrame:
    """(span, key, score, exact): roads for each distinct span; exact ones, else up to three of a ratio of 85 or more with equal numbers."""
    keys = entities.select(F.col("road_key").alias("key")).distinct()
    s = spans.select("span").distinct()
    exact = s.join(keys, s.span == keys.key).select("span", "key", F.lit(100.0).alias("score"), F.lit(True).alias("exact"))
    if not fuzzy:
        return exact
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    side = lambda df, c: df.select(c, T.alpha_part(F.col(c)).alias(f"{c}_alpha"), F.array_join(T.number_part(F.col(c)), " ").alias("nums"))
    left = side(s.join(exact.select("span"), "span", "left_anti"), "span").where("length(span_alpha) >= 4").withColumn("piece", F.explode(pieces(F.col("span_alpha"))))
    right = side(keys, "key").withColumn("piece", F.explode(pieces(F.col("key_alpha"))))
    # 2 * common / total can't reach 85 % where one is over 1.36 times as long as the other
    near = F.least(F.length("span_alpha"), F.length("key_alpha")) * 1.36 >= F.greatest(F.length("span_alpha"), F.length("key_alpha"))
    pairs = left.join(right, ["nums", "piece"]).where(near).select("span", "key", "span_alpha", "key_alpha").distinct()
    scored = pairs.withColumn("score", similarity.indel_ratio("span_alpha", "key_alpha")).where("score >= 85")
    rank = F.row_number().over(W.partitionBy("span").orderBy(F.desc("score"), "key"))
    fuzzy_hits = scored.withColumn("r", rank).where("r <= 3").select("span", "key", "score", F.lit(False).alias("exact"))
    return exact.unionByName(fuzzy_hits)


def _corrected(variants: DataFrame, entities: DataFrame) -> DataFrame:
    """Word lists with words unknown to the reference replaced by the nearest road word, beside the lists as they are."""
    vocabulary = entities.select("eid", F.explode(F.split("road_key", " ")).alias("word")).where(r"word rlike '^[A-Z]{3,}$'").groupBy("word").agg(F.count("*").alias("freq"))
    types = entities.sparkSession.createDataFrame([(w, s) for w, s in T.TYPE_WORDS.items()], "full string, short string")
    known = vocabulary.select("word").unionByName(entities.select(F.explode("buildings").alias("b")).distinct().select(F.explode(F.split(T.match_key("b"), " ")).alias("word"))).distinct()
    words = variants.select("id", "v", "toks", F.posexplode("toks").alias("i", "word"))
    odd = words.select("word").distinct().where(r"word rlike '^[A-Z]{4,}$'").join(known, "word", "left_anti")
    spelt = vocabulary.unionByName(types.select(F.col("full").alias("word"), F.lit(1 << 40).alias("freq"))).groupBy("word").agg(F.max("freq").alias("freq"))
    fixed = recall.nearest_words(odd, spelt).join(types, F.col("fixed") == F.col("full"), "left").select("word", F.coalesce("short", "fixed").alias("fixed"))
    changed = words.join(fixed, "word", "left").groupBy("id", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("fixed", "word").alias("w")))), lambda x: x.w).alias("toks"), F.first("toks").alias("orig"))
    same = variants.select("id", "v", "toks", F.col("toks").alias("orig"))
    return same.unionByName(changed.where("toks <> orig").select("id", (F.col("v") + 2).alias("v"), "toks", "orig"))


def hypotheses(parsed: DataFrame, entities: DataFrame, fuzzy: bool = True) -> DataFrame:
    """One row for each reading of an input: block option, road option, words, agreement with the reference."""
    v = parsed.select("id", F.posexplode("variants").alias("v", "toks"))
    v = cut(_corrected(v, entities)) if fuzzy else v.withColumn("orig", F.col("toks"))
    base = v.join(parsed.select("id", "block_marked"), "id")
    places = F.filter(F.transform("toks", lambda t, i: F.when(t.rlike(parsing.BLOCK), i)), lambda i: i.isNotNull())
    options = F.when(F.col("block_marked").isNotNull(), F.array(F.lit(-1))).otherwise(F.concat(places, F.array(F.lit(-1))))
    h = base.select("id", "v", "toks", "orig", "block_marked", F.posexplode(options).alias("o", "at"))
    blk = F.when(F.col("block_marked").isNotNull(), F.col("block_marked")).when(F.col("at") >= 0, F.get("toks", F.col("at")))
    drop = lambda c: F.filter(c, lambda w, i: i != F.col("at"))
    h = cut(h.select("id", "v", "o", "at", blk.alias("blk"), drop("toks").alias("toks"), drop("orig").alias("orig"), F.col("toks").alias("all")))
    spans = h.select("id", "v", "o", F.explode(recall.spans(F.col("toks"))).alias("s")).select("id", "v", "o", "s.*").where(~F.split("span", " ")[0].rlike("[0-9]"))
    found = spans.join(cut(_roads(spans, entities, fuzzy)), "span")
    best = W.partitionBy("id", "v", "o", "key").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start")
    found = found.withColumn("r", F.row_number().over(best)).where("r = 1")
    top = W.partitionBy("id", "v", "o").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", "key")
    found = found.withColumn("rank", F.row_number().over(top)).where("rank <= 5")
    lists = found.groupBy("id", "v", "o").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "start", "end", "score", "exact"))).alias("roads"))
    h = h.join(lists, ["id", "v", "o"], "left")
    nothing = F.struct(F.lit(9).alias("rank"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(False).alias("exact"))
    roads = F.coalesce("roads", F.array().cast("array<struct<rank:int,key:string,start:int,end:int,score:double,exact:boolean>>"))
    h = h.withColumn("spans", roads).withColumn("road", F.explode(F.concat(roads, F.array(nothing))))
    typed = F.slice("toks", F.col("road.start") + 1, F.col("road.end") - F.col("road.start")) == F.slice("orig", F.col("road.start") + 1, F.col("road.end") - F.col("road.start"))
    # a road that is exact only after a correction counts as corrected
    exact = F.col("road.exact") & typed
    h = h.withColumns({"road_key": F.col("road.key"), "exact": exact, "score": F.when(F.col("road.exact") & ~typed, 95.0).otherwise(F.col("road.score")), "start": F.col("road.start"), "end": F.col("road.end"), "rank": F.col("road.rank")})
    left = F.filter(F.col("toks"), lambda w, i: F.col("road_key").isNull() | (i < F.col("start")) | (i >= F.col("end")))
    inside = F.exists("spans", lambda s: (s.start <= F.col("start")) & (s.end >= F.col("end")) & (s.end - s.start > F.col("end") - F.col("start")))
    h = h.withColumns({"leftover": left, "dominated": F.col("road_key").isNotNull() & inside})
    # taking a number out of a road that is exact with it steals it
    plain = h.where("at = -1 and road_key is not null and road.exact").select("id", "v", "start", "end").groupBy("id", "v").agg(F.collect_set(F.struct("start", "end")).alias("cover"))
    h = h.join(plain, ["id", "v"], "left")
    steal = (F.col("at") >= 0) & F.coalesce(F.exists("cover", lambda c: (c.start <= F.col("at")) & (F.col("at") < c.end)), F.lit(False))
    return cut(h.withColumn("steal", steal)).drop("road", "roads", "spans", "cover", "all")


#: What an input's hypothesis is held against, and the columns of an entity that it must share: br is short for block and road, p for postcode.
_HELD = {"br": ("blk", "road_key"), "p": ("postal",), "on": ("postal", "road_key"), "pb": ("postal", "blk"), "both": ("postal", "blk", "road_key")}


def _best(h: DataFrame, asked: DataFrame, entities: DataFrame) -> DataFrame:
    """The best hypothesis of each (g, id, postal): ranked by counts of entities, which grow with nothing, not by lists of them."""
    names = _buildings(entities).withColumnRenamed("b", "name")
    whole = names.groupBy("name").agg(F.countDistinct("eid").alias("whole_n"), F.first("blk").alias("whole_blk"))
    roads = entities.select(F.col("road_key").alias("name")).distinct().withColumn("is_road", F.lit(True))
    count = lambda name: entities.groupBy(*_HELD[name]).agg(F.count("*").alias(f"{name}_n"))
    x = h.withColumn("name", F.array_join("toks", " ")).join(whole, "name", "left").join(roads, "name", "left").join(count("br"), list(_HELD["br"]), "left")
    unique = F.col("road_key").isNull() & (F.size("toks") > 0) & F.col("is_road").isNull() & (F.col("whole_n") == 1) & (F.col("blk").isNull() | (F.col("whole_blk") == F.col("blk")))
    x = x.select("id", "v", "o", "rank", "blk", "road_key", "exact", "steal", "dominated", "score", F.size("toks").alias("words"), (F.col("end") - F.col("start")).alias("n"), F.coalesce(unique, F.lit(False)).alias("unique"), "br_n")
    x = x.join(asked, "id")
    for name in ("p", "on", "pb", "both"):
        x = x.join(count(name), list(_HELD[name]), "left")
    any_of = lambda name: F.coalesce(F.col(f"{name}_n") > 0, F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    agree = (any_of("br") & ~(any_of("p") & ~F.col("exact") & ~any_of("on"))) | F.col("unique") | (F.col("road_key").isNull() & any_of("pb"))
    order = F.struct(
        flag(any_of("both")), flag(~F.col("steal")), flag(~F.col("dominated")), flag(agree), F.when(F.col("unique"), F.col("words")).otherwise(F.col("n")), flag(any_of("on")), flag(F.col("exact")),
        flag(F.col("unique")), F.col("score"), F.col("n"), flag(F.col("blk").isNotNull()), -F.col("v"), -F.col("o"), -F.col("rank"),
    )
    best = x.groupBy("g", "id", "postal").agg(F.max_by(F.struct("v", "o", "rank"), order).alias("h")).select("g", "id", "postal", "h.*")
    return best.join(h.select("id", "v", "o", "rank", "blk", "road_key", "exact", "toks", "leftover"), ["id", "v", "o", "rank"])


def _picked(d: DataFrame, entities: DataFrame) -> DataFrame:
    """(g, named_n, named_one): of the entities that each row of (g, kind, postal, blk, road_key, leftover) may pick, those that the leftover words name.

    Entities that share a key and have the same buildings are named together, so that each distinct list of buildings is looked at once.
    """
    key = lambda name: F.array(F.lit(name), *(F.col(c) for c in _HELD[name]))
    kinds = ("br", "p", "on", "both")
    asked = d.select("g", F.coalesce(*(F.when(F.col("kind") == k, key(k)) for k in kinds)).alias("key"), "leftover")
    held = entities.where("size(buildings) > 0").select("eid", "buildings", F.explode(F.array(*(key(k) for k in kinds))).alias("key"))
    lists = held.groupBy("key", "buildings").agg(F.count("*").alias("n"), F.min("eid").alias("one"))
    found = asked.select("key", "leftover").distinct().join(lists, "key").where(_named(F.struct("buildings"), F.col("leftover")))
    found = found.groupBy("key", "leftover").agg(F.sum("n").alias("named_n"), F.min("one").alias("named_one"))
    return asked.join(found, ["key", "leftover"]).select("g", "named_n", "named_one")


def _named(entity: Column, words: Column) -> Column:
    """Whether the words are all among, or hold all, words of one of the entity's buildings (a token-set ratio of 100)."""
    return F.exists(entity["buildings"], lambda b: (F.size(F.array_except(words, F.split(b, " "))) == 0) | (F.size(F.array_except(F.split(b, " "), words)) == 0))


def validate(inputs: DataFrame, entities: DataFrame, floors: DataFrame | None = None, strictness: str = "BALANCED", fuzzy: bool = True, assume_complete: bool = True, text: str = "text", key: str = "id") -> DataFrame:
    """Every input row with action, eid, address, reasons, statuses and candidates.

    ``floors`` (postal, max_floor) checks units. A null or empty text is FIX with NO_MATCH. Each distinct text is resolved
    once, so repeated ids and texts each keep their rows.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    spark = entities.sparkSession
    # the number is given, as adaptive execution would deal the few bytes read to few tasks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    texts = inputs.select(said.alias("text")).distinct().repartition(parts, "text")
    # readings depend on the words alone (id), which many texts share; what is picked depends on the postcode too (g)
    words = F.array_join(F.transform("variants", lambda x: F.array_join(x, " ")), "|")  # a hash of lists skips nulls and doesn't see where a list ends
    parsed = parsing.parse(texts).withColumn("id", F.xxhash64(words, F.coalesce("block_marked", F.lit(""))))
    parsed = cut(parsed.withColumn("g", F.xxhash64("id", F.coalesce("postal", F.lit("")))))
    asked = parsed.select("g", "id", "postal").distinct()
    h = hypotheses(parsed.select("id", "variants", "block_marked").dropDuplicates(["id"]), entities, fuzzy)
    d = cut(asked.join(_best(h, asked, entities).drop("id", "postal"), "g", "left"))
    d = d.withColumns({"toks": F.coalesce("toks", F.array().cast("array<string>")), "leftover": F.coalesce("leftover", F.array().cast("array<string>"))})
    # roads: how many entities, the only one, the first five and the three nearest numbers
    d = d.join(entities.groupBy("road_key").agg(F.count("*").alias("road_n"), F.min("eid").alias("road_one")), "road_key", "left")
    for name, keys in _HELD.items():
        d = d.join(_groups(entities, name, *keys), list(keys), "left").withColumn(f"{name}_n", F.coalesce(f"{name}_n", F.lit(0)))
    # blocks of the postcode and road that have the input's number and a letter
    bare = F.regexp_replace("blk", "[A-Z]+$", "")
    letters = _groups(entities.where(bare != F.col("blk")).select("eid", "postal", "road_key", bare.alias("blk")), "letter", "postal", "road_key", "blk")
    d = d.join(letters, ["postal", "road_key", "blk"], "left").withColumn("letter_n", F.when(F.col("blk").rlike("^[0-9]+$"), F.col("letter_n")))
    names = _buildings(entities).drop("road_key")
    whole = names.groupBy("b").agg(F.array_sort(F.collect_set(F.struct("eid", "blk"))).alias("named"))
    d = d.withColumn("b", F.array_join("leftover", " ")).join(whole, "b", "left")
    lists = d.where("named is null and road_key is null and size(leftover) > 0").select("leftover").distinct()
    held = recall.containing_all(lists.select(F.array_join("leftover", " ").alias("probe_id"), F.explode("leftover").alias("word")), names.select(F.col("eid").alias("holder_id"), F.explode(F.split("b", " ")).alias("word")))
    held = held.join(entities.select(F.col("eid").alias("holder_id"), "blk"), "holder_id").groupBy(F.col("probe_id").alias("b")).agg(F.array_sort(F.collect_set(F.struct(F.col("holder_id").alias("eid"), "blk"))).alias("held"))
    d = d.join(held, "b", "left")
    pois = F.coalesce("named", "held")
    same_blk = F.filter(pois, lambda x: x.blk == F.col("blk"))
    d = d.withColumn("pois", F.when(F.col("blk").isNotNull() & (F.size(same_blk) > 0), same_blk).otherwise(pois))
    # ---- decision: the branch first, then what it picks
    some = lambda name: F.col(f"{name}_n") > 0
    one = lambda name: F.col(f"{name}_n") == 1
    first = lambda name: F.get(f"{name}_five", F.lit(0))
    road, blk = F.col("road_key").isNotNull(), F.col("blk").isNotNull()
    branch = (
        F.when(some("both"), "agree").when(some("br") & some("p") & one("letter"), "letter").when(some("br") & some("p") & some("on"), "block_conflict")
        .when(some("br") & some("p"), "mismatch").when(some("br"), "block_road").when(some("p") & ~road & ~blk, "postal_only").when(some("p") & road & some("on") & ~blk, "postal_road")
        .when(some("p") & road & one("on") & F.lit(strictness != "STRICT"), "replace_block").when(some("p") & road, "street_mismatch").when(some("p"), "postal_block")
        .when(road & blk, "premise" if assume_complete else "unverified").when(road, "road_only").when(F.size("pois") == 1, "poi").when(F.size("pois") > 1, "pois").otherwise("nothing")
    )
    d = d.withColumn("branch", branch)
    at = lambda *names: F.col("branch").isin(*names)
    # several are left to pick from
    kind = F.when(at("agree") & ~one("both"), "both").when(at("mismatch", "block_road") & ~one("br"), "br").when(at("postal_only") & ~one("p"), "p").when(at("postal_road") & ~one("on"), "on")
    d = cut(d.withColumn("kind", kind))
    d = d.join(_picked(d.where("kind is not null"), entities), "g", "left")
    pick = lambda name: F.when(one(name), first(name)).when(F.col("named_n") == 1, F.col("named_one"))
    eid = (
        F.when(at("agree"), F.coalesce(pick("both"), first("both"))).when(at("letter"), first("letter")).when(at("mismatch", "block_road"), pick("br")).when(at("postal_only"), pick("p"))
        .when(at("postal_road"), pick("on")).when(at("replace_block"), first("on")).when(at("postal_block") & one("pb"), first("pb"))
        .when(at("road_only") & (F.col("road_n") == 1), F.col("road_one")).when(at("poi"), F.get("pois", F.lit(0)).eid)
    )
    d = d.withColumn("eid", eid)
    none, code = F.col("eid").isNull(), F.col("postal").isNotNull()
    why = (
        F.when(at("letter", "replace_block"), "BLOCK_REPLACED_BY_POSTCODE").when(at("block_conflict"), "POSTCODE_BLOCK_CONFLICT").when(at("mismatch", "block_road", "postal_only", "postal_road", "pois") & none, "AMBIGUOUS_MULTIPLE_CANDIDATES")
        .when(at("mismatch", "street_mismatch") | (at("postal_block") & none), "POSTCODE_STREET_MISMATCH").when(at("block_road") & code, "POSTCODE_NOT_FOUND").when(at("postal_only"), "POSTCODE_ONLY")
        .when(at("premise"), "PREMISE_NOT_FOUND").when(at("unverified"), "PREMISE_UNVERIFIED_LOW_COVERAGE").when(at("road_only") & none, "MISSING_PREMISE").when(at("poi"), "BUILDING_NAME_ONLY").when(at("nothing"), "NO_MATCH")
    )
    both_lists = F.concat(F.coalesce("br_five", F.array().cast("array<bigint>")), F.coalesce("on_five", F.array().cast("array<bigint>")))
    listed = F.when(at("block_conflict"), both_lists).when(at("street_mismatch", "postal_block", "postal_only"), F.col("p_five")).when(at("mismatch", "block_road"), F.col("br_five")).when(at("postal_road"), F.col("on_five"))
    nothing = F.array().cast("array<bigint>")
    d = d.withColumns({"why": why, "candidates": F.when(none, F.coalesce(F.slice(listed, 1, 5), F.transform(F.slice("pois", 1, 5), lambda x: x.eid), nothing)).otherwise(nothing)})
    d = d.select("g", "blk", "road_key", "exact", "leftover", "branch", "eid", "why", "candidates")
    d = parsed.select("g", "text", "postal", "zero_restored", "unit_floor", "unit_no", "unit_raw").join(d, "g", "left")
    d = cut(d).join(entities.select(*(F.col(c).alias(f"e_{c}") for c in _ENTITY)), F.col("eid") == F.col("e_eid"), "left")
    # ---- statuses of the chosen entity's components
    poi = at("poi")
    premise = F.when(~blk, "inferred").when(F.col("blk") == F.col("e_blk"), "confirmed").otherwise("replaced")
    route = F.when(~road, "inferred").when(F.col("road_key") == F.col("e_road_key"), F.when(F.col("exact"), "confirmed").otherwise("corrected")).otherwise("replaced")
    postal = F.when(~code, "inferred").when(F.col("postal") == F.col("e_postal"), "confirmed").otherwise("replaced")
    own = F.concat(F.split("e_road_key", " "), F.array(F.col("e_blk"), F.col("e_postal"), *(F.lit(x) for x in ("SINGAPORE", "SG", "BLK", "BLOCK"))))
    extra = F.filter("leftover", lambda w: ~F.array_contains(own, w))
    d = cut(d.withColumns({"premise": premise, "route": route, "postcode": postal, "extra": extra}))
    keyed = F.struct(F.transform("e_buildings", T.match_key).alias("buildings"))
    known = (F.size("extra") == 0) | (F.size(F.coalesce("e_buildings", F.array().cast("array<string>"))) > 0) & _named(keyed, F.col("extra")) | poi
    three = (F.col("premise") == "confirmed") & (F.col("route") == "confirmed") & (F.col("postcode") == "confirmed")
    harmless = three & F.lit(strictness != "STRICT") & F.forall("extra", lambda w: w.rlike("^[A-Z]+$")) & (F.size("extra") <= 6)
    d = d.withColumn("rest", F.when(known, "none").when(harmless, "name").otherwise("odd"))
    floors = floors if floors is not None else entities.sparkSession.createDataFrame([], "postal string, max_floor int")
    d = d.join(floors.select(F.col("postal").alias("e_postal"), "max_floor"), "e_postal", "left")
    unit = F.col("unit_floor").isNotNull()
    too_high = unit & ~F.col("unit_floor").startswith("B") & (F.col("unit_floor").try_cast("int") > F.col("max_floor"))
    too_high = F.coalesce(too_high, F.lit(False))
    any_of = lambda s: (F.col("premise") == s) | (F.col("route") == s) | (F.col("postcode") == s)
    odd = (F.col("rest") == "odd") | F.col("unit_raw").isNotNull()
    doubt = any_of("replaced") | odd | poi
    if strictness != "LENIENT":
        doubt = doubt | any_of("inferred") | any_of("corrected")
    if strictness == "STRICT":
        doubt = doubt | unit
    homes = F.coalesce(T.is_public_housing(F.col("e_blk"), F.col("e_postal")), F.lit(False))
    asks = ~unit & (F.col("max_floor").isNotNull() | homes)
    action = F.when(none, F.when(at("unverified"), "CONFIRM").otherwise("FIX")).when(too_high, "FIX").when(~unit & F.col("max_floor").isNotNull(), "CONFIRM_ADD_SUBPREMISES").when(doubt, "CONFIRM").when(asks, "CONFIRM_ADD_SUBPREMISES").otherwise("ACCEPT")
    has = ~none
    quiet = F.coalesce(F.col("why") == "POSTCODE_ONLY", F.lit(False)) | poi
    reasons = F.array_compact(F.array(
        F.col("why"), F.when(has & ~blk & ~quiet, "BLOCK_INFERRED"), F.when(has & ~road & ~quiet, "STREET_INFERRED"), F.when(has & (F.col("route") == "corrected"), "STREET_SPELL_CORRECTED"), F.when(has & (F.col("route") == "replaced"), "STREET_REPLACED"),
        F.when(has & (F.col("postcode") == "inferred"), "POSTCODE_INFERRED"), F.when(has & (F.col("postcode") == "confirmed") & F.col("zero_restored"), "POSTCODE_LEADING_ZERO_RESTORED"),
        F.when(has & (F.col("rest") == "name"), "UNVERIFIED_NAME"), F.when(has & (F.col("rest") == "odd"), "UNRESOLVED_TOKENS"), F.when(has & too_high, "UNIT_FLOOR_EXCEEDS_BUILDING"), F.when(has & F.col("unit_raw").isNotNull(), "UNIT_FORMAT_INVALID"),
        F.when(has & asks & ~too_high, "UNIT_MISSING_MULTI_UNIT_BUILDING"),
    ))
    shown = F.when(has, F.concat_ws(" ", "e_blk", "e_road", "e_postal"))
    unit_text = F.when(F.col("unit_no").isNotNull(), F.concat(F.lit("#"), "unit_floor", F.lit("-"), "unit_no")).when(unit, F.concat(F.lit("Level "), F.regexp_replace("unit_floor", "^0(?=.)", "")))
    out = d.select(
        F.col("text").alias("__text"), action.alias("action"), "eid", shown.alias("address"), unit_text.alias("unit"), reasons.alias("reasons"), F.when(has, F.struct("premise", "route", F.col("postcode").alias("postal"))).alias("status"), "candidates",
    )
    kept = inputs if len(inputs.columns) > 2 else inputs.select(key, text)
    joined = kept.join(out, said == F.col("__text"), "left").drop("__text")
    return joined if len(inputs.columns) > 2 else joined.drop(text)
