"""A deterministic address world over the benchmark tables: streets, points, entities, places and free-text inputs.

``SQL`` says the same in DuckDB, so each query over the world has a twin there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class World:
    """The world's tables for one folder of benchmark tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def area(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("area_id"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("area"), F.col("r_name").alias("parent"))

    @property
    def street(self) -> DataFrame:
        kind = F.get(F.array(*(F.lit(x) for x in ("STREET", "ROAD", "AVENUE", "LANE"))), F.col("p_size") % 4)
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("street_id"), F.concat_ws(" ", F.upper("p_name"), kind).alias("name"), (k % 25).cast("int").alias("area_id"), (1.0 + (k % 500) / 1000).alias("lat"), (103.0 + (k * 7 % 500) / 1000).alias("lng")
        )

    @property
    def point(self) -> DataFrame:
        p = self.table("lineitem").select(F.col("l_partkey").alias("street_id"), F.col("l_quantity").cast("int").alias("number")).distinct()
        s, n = F.col("street_id"), F.col("number")
        return p.join(self.street, "street_id").select(
            (s * 100 + n).alias("point_id"), "street_id", "name", "area_id", "number",
            F.concat(n.cast("string"), F.when((s + n) % 4 == 0, "A").otherwise("")).alias("blk"),
            F.lpad(((s * 50 + n * 3) % 1000000).cast("string"), 6, "0").alias("postal"),
            (F.col("lat") + n / 10000).alias("lat"), (F.col("lng") + n % 7 / 10000).alias("lng"),
            F.when(n % 10 == 0, F.concat(F.lit("TOWER "), F.split("name", " ")[0], F.lit(" "), (s % 50).cast("string"))).alias("building"),
        )

    @property
    def place(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("place_id"), F.upper("s_name").alias("name"), (k % 25).cast("int").alias("area_id"), (F.abs("s_acctbal") * 10).cast("long").alias("population"), (1.0 + (k * 13 % 500) / 1000).alias("lat"), (103.0 + (k * 29 % 500) / 1000).alias("lng")
        )

    @property
    def input(self) -> DataFrame:
        o, s = self.table("orders").select("o_orderkey", "o_custkey"), self.street
        k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 50 + 1).cast("int")
        postal = F.lpad(((F.col("street_id") * 50 + n * 3) % 1000000).cast("string"), 6, "0")
        number = n.cast("string")
        text = (
            F.when(k % 6 == 0, F.concat(number, F.lit(" "), F.col("name"), F.lit(", Singapore "), postal))
            .when(k % 6 == 1, F.concat(number, F.lit(" "), F.initcap("name")))
            .when(k % 6 == 2, F.concat(F.lit("Blk "), number, F.lit(" "), F.col("name"), F.lit(" #05-"), F.lpad(number, 2, "0"), F.lit(" S("), postal, F.lit(")")))
            .when(k % 6 == 3, F.concat(F.col("name"), F.lit(" "), number, F.lit(" "), F.substring(postal, 2, 5)))
            .when(k % 6 == 4, F.concat(number, F.lit(" "), F.col("name"), F.lit(" "), F.lpad(((F.col("street_id") * 50 + n * 3 + 1) % 1000000).cast("string"), 6, "0")))
            .otherwise(F.col("name"))
        )
        return o.join(s, F.col("o_custkey") == F.col("street_id")).select(k.alias("input_id"), "street_id", "name", n.alias("number"), postal.alias("truth_postal"), text.alias("text"))


SQL = """
area AS (SELECT n_nationkey AS area_id, replace(n_name, '_', ' ') AS area, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey),
street AS (SELECT p_partkey AS street_id, upper(p_name) || ' ' || CASE p_size % 4 WHEN 0 THEN 'STREET' WHEN 1 THEN 'ROAD' WHEN 2 THEN 'AVENUE' ELSE 'LANE' END AS name,
  (p_partkey % 25)::INT AS area_id, 1.0::DOUBLE + (p_partkey % 500) / 1000.0::DOUBLE AS lat, 103.0::DOUBLE + (p_partkey * 7 % 500) / 1000.0::DOUBLE AS lng FROM part),
point AS (SELECT p.street_id * 100 + p.number AS point_id, p.street_id, name, area_id, p.number, p.number::VARCHAR || CASE WHEN (p.street_id + p.number) % 4 = 0 THEN 'A' ELSE '' END AS blk,
  lpad(((p.street_id * 50 + p.number * 3) % 1000000)::VARCHAR, 6, '0') AS postal, lat + p.number / 10000.0::DOUBLE AS lat, lng + (p.number % 7) / 10000.0::DOUBLE AS lng,
  CASE WHEN p.number % 10 = 0 THEN 'TOWER ' || string_split(name, ' ')[1] || ' ' || (p.street_id % 50)::VARCHAR END AS building
  FROM (SELECT DISTINCT l_partkey AS street_id, l_quantity::INT AS number FROM lineitem) AS p JOIN street USING (street_id)),
place AS (SELECT s_suppkey AS place_id, upper(s_name) AS name, (s_suppkey % 25)::INT AS area_id, trunc(abs(s_acctbal) * 10)::BIGINT AS population,
  1.0::DOUBLE + (s_suppkey * 13 % 500) / 1000.0::DOUBLE AS lat, 103.0::DOUBLE + (s_suppkey * 29 % 500) / 1000.0::DOUBLE AS lng FROM supplier),
input0 AS (SELECT o_orderkey AS k, street_id, name, (o_orderkey % 50 + 1)::INT AS number FROM orders JOIN street ON o_custkey = street_id),
input1 AS (SELECT *, lpad(((street_id * 50 + number * 3) % 1000000)::VARCHAR, 6, '0') AS truth_postal,
  array_to_string(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS said FROM input0),
input AS (SELECT k AS input_id, street_id, name, number, truth_postal, CASE k % 6 WHEN 0 THEN number || ' ' || name || ', Singapore ' || truth_postal WHEN 1 THEN number || ' ' || said
  WHEN 2 THEN 'Blk ' || number || ' ' || name || ' #05-' || lpad(number::VARCHAR, 2, '0') || ' S(' || truth_postal || ')' WHEN 3 THEN name || ' ' || number || ' ' || substr(truth_postal, 2, 5)
  WHEN 4 THEN number || ' ' || name || ' ' || lpad(((street_id * 50 + number * 3 + 1) % 1000000)::VARCHAR, 6, '0') ELSE name END AS text FROM input1)"""
