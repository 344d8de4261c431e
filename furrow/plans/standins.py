"""Crop-shaped inputs taken from the driver tables.

part stands for crop, part type for crop family, the supplier's region for the
growing region, the ship month for the period, extended price per unit for the
price, quantity for the yield, discount and tax for cost rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.functions.calendar import month_index
from furrow.sources.tables import table

def amount():
    return exact.decimal(F.col("l_extendedprice"))


def units():
    return exact.decimal(F.col("l_quantity"))


def charge():
    rate = exact.decimal(F.col("l_discount"), 2, 5) + exact.decimal(F.col("l_tax"), 2, 5)
    return amount() * rate


def supplier_regions(spark: SparkSession, base: str) -> DataFrame:
    suppliers = table(spark, base, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, base, "nation").select("n_nationkey", "n_regionkey")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("region_id")
    )


def lines(spark: SparkSession, base: str) -> DataFrame:
    """Line items with crop, region and month."""
    return (
        table(spark, base, "lineitem")
        .join(supplier_regions(spark, base), "l_suppkey")
        .withColumn("crop_id", F.col("l_partkey"))
        .withColumn("t", month_index(F.col("l_shipdate")))
    )


def observations(spark: SparkSession, base: str) -> DataFrame:
    """Exact revenue, units and cost per (crop, region, month)."""
    return lines(spark, base).groupBy("crop_id", "region_id", "t").agg(
        F.sum(amount()).alias("revenue"), F.sum(units()).alias("units"), F.sum(charge()).alias("cost")
    )


OBSERVATIONS_SQL = """
obs AS (
  SELECT l_partkey AS crop_id, n_regionkey AS region_id,
         (year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS t,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue,
         sum(CAST(l_quantity AS DECIMAL(18,2))) AS units,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))
             * (CAST(l_discount AS DECIMAL(5,2)) + CAST(l_tax AS DECIMAL(5,2)))) AS cost
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""


def price_series(spark: SparkSession, base: str) -> DataFrame:
    """(crop_id, t, value): unit price per crop and month, to the hundredth."""
    return (
        table(spark, base, "lineitem")
        .groupBy(F.col("l_partkey").alias("crop_id"), month_index(F.col("l_shipdate")).alias("t"))
        .agg(F.sum(amount()).alias("a"), F.sum(units()).alias("u"))
        .select("crop_id", "t", exact.half_up_price(F.col("a"), F.col("u")).alias("value"))
    )


PRICE_SERIES_SQL = """
series AS (
  SELECT crop_id, t,
         CAST(CAST((2 * CAST(a * 100 AS HUGEINT) + CAST(u AS HUGEINT)) // (2 * CAST(u AS HUGEINT))
              AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS value
  FROM (SELECT l_partkey AS crop_id, CAST((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t,
               sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS a,
               sum(CAST(l_quantity AS DECIMAL(18,2))) AS u
        FROM lineitem GROUP BY 1, 2))"""


def month_sql(t: str) -> str:
    return f"(CAST({t} // 12 + 1970 AS VARCHAR) || '-' || lpad(CAST({t} % 12 + 1 AS VARCHAR), 2, '0'))"


def families(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "part").select(F.col("p_partkey").alias("crop_id"), F.col("p_type").alias("family"))


def event_number() -> Column:
    """The number inside an event's properties."""
    return F.get_json_object("props", "$.k").cast("int")


EVENT_NUMBER_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
