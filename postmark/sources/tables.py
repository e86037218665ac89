"""Reading and writing reference tables, attributes, gazetteers and batches. Postcodes and numbers stay strings: no schema is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postmark.operators import resolve

REFERENCE = "blk string, road string, postal string, buildings string, lat double, lng double"
#: The columns of a gazetteer dump (tab-separated, public format).
GAZETTEER = (
    "id long, name string, ascii string, alternatives string, lat double, lng double, class string, code string, country string, cc2 string, "
    "admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation string, dem string, zone string, changed string"
)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a CSV (plain or gzip) with header blk, road, postal, buildings, lat, lng."""
    return resolve.reference(spark.read.schema(REFERENCE).option("header", True).option("enforceSchema", False).csv(path))


def read_floors(spark: SparkSession, path: str) -> DataFrame:
    """(postal, max_floor) of a CSV; rows without a floor are left out."""
    return spark.read.schema("postal string, max_floor int").option("header", True).csv(path).where("max_floor is not null").withColumn("postal", F.trim("postal"))


def entities_of_dump(records: DataFrame) -> DataFrame:
    """Reference rows of a building dump (BLK_NO, ROAD_NAME, POSTAL, BUILDING, LATITUDE, LONGITUDE): one for each block, road and postcode."""
    t = records.select(*(F.trim(c).alias(n) for c, n in (("BLK_NO", "blk"), ("ROAD_NAME", "road"), ("POSTAL", "postal"), ("BUILDING", "building"))), F.col("LATITUDE").cast("double").alias("lat"), F.col("LONGITUDE").cast("double").alias("lng"))
    t = t.where("blk <> '' and blk <> 'NIL' and road <> '' and road <> 'NIL' and length(postal) = 6")
    names = F.array_sort(F.collect_set(F.when((F.col("building") != "") & (F.col("building") != "NIL"), F.col("building"))))
    first = F.min(F.struct("lat", "lng"))
    return t.groupBy("blk", "road", "postal").agg(F.array_join(names, "|").alias("buildings"), first.alias("at")).select("blk", "road", "postal", "buildings", "at.lat", "at.lng")


def write_reference(rows: DataFrame, path: str) -> None:
    """A gzip CSV in the fixed column order."""
    rows.select("blk", "road", "postal", "buildings", "lat", "lng").write.mode("overwrite").option("header", True).csv(path, compression="gzip")


def in_box(south: float, west: float, north: float, east: float, box: str = "bbox") -> Column:
    """Rows whose box meets this one; comparisons of nested fields reach the Parquet scan."""
    b = F.col(box)
    return (b.xmin < east) & (b.xmax > west) & (b.ymin < north) & (b.ymax > south)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Places of a gazetteer dump: populated places and the first three administrative levels, historical ones left out."""
    t = spark.read.schema(GAZETTEER).option("sep", "\t").option("quote", "").csv(path)
    t = t.where("class = 'P' and code not in ('PPLH', 'PPLQ', 'PPLW') or class = 'A' and code in ('ADM1', 'ADM2', 'ADM3')")
    kind = F.when(F.col("code") == "PPLX", "X").when(F.col("class") == "P", "P").otherwise(F.concat(F.lit("A"), F.substring("code", 4, 1)))
    names = F.array_distinct(F.array_compact(F.concat(F.array("name", "ascii"), F.split(F.coalesce("alternatives", F.lit("")), ","))))
    keep = F.filter(names, lambda n: (F.length(n) >= 3) & ~n.rlike("[0-9]") & ~n.rlike("^[A-Z]{3,4}$"))
    return t.select("id", keep.alias("names"), "lat", "lng", kind.alias("kind"), F.coalesce("population", F.lit(0)).alias("population"), "admin1")


def gazetteer_names(places: DataFrame, most: int = 40) -> DataFrame:
    """(name, place) pairs; of a name with more places than ``most``, those of most people."""
    n = places.select("id", "lat", "lng", "kind", "population", F.explode("names").alias("name")).withColumn("name", F.upper("name")).distinct()
    return n.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy(F.desc("population"), "id"))).where(F.col("r") <= most).drop("r")


def flatten(results: DataFrame) -> DataFrame:
    """Validation results as flat text columns for a file: lists joined by |, three candidates at most."""
    return results.select(
        *(c for c in results.columns if c not in ("action", "eid", "address", "unit", "reasons", "status", "candidates")), F.col("action").alias("av_action"), F.col("address").alias("av_address"),
        F.array_join("reasons", "|").alias("av_reasons"), F.array_join(F.slice("candidates", 1, 3).cast("array<string>"), "|").alias("av_candidates"), F.col("error").alias("av_error") if "error" in results.columns else F.lit(None).cast("string").alias("av_error"),
    )


def validate_batch(rows: DataFrame, entities: DataFrame, text: str = "text", region: str = "region", supported: tuple[str, ...] = ("SG",), **options) -> DataFrame:
    """Every row with its ``av_`` columns; a row of another region or without text has an error and no result. Rows keep their own columns."""
    held = rows.withColumn("__id", F.monotonically_increasing_id())
    held = resolve.cut(held)  # the ids must not change between the two uses
    code = F.upper(F.coalesce(F.col(region), F.lit("SG")))
    error = F.when(~code.isin(*supported), F.concat(F.lit("unsupported region: "), code)).when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "empty text")
    held = held.withColumn("error", error)
    got = resolve.validate(held.where("error is null").select(F.col("__id").alias("id"), F.col(text).alias("text")), entities, **options)
    return flatten(held.join(got.withColumnRenamed("id", "__id"), "__id", "left").drop("__id"))
