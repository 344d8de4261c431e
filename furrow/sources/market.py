"""Price, yield and cost observations, and the mapping of source names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MARKET_SCHEMA = "crop_id bigint, region_id int, period date, price double, yield double, cost double"
MAPPING_SCHEMA = "source_name string, crop_id bigint"


def read_market(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = MARKET_SCHEMA) -> DataFrame:
    """Typed read without inference; CSV files carry a header."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "FAILFAST")
    return reader.format(fmt).load(path)


def read_mapping(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_market(spark, path, fmt, MAPPING_SCHEMA)
