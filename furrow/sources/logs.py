"""Append logs of inference and feedback, and the training-sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INFERENCE_SCHEMA = "request_id bigint, ts timestamp, user_id bigint, crop_id bigint, score double"
FEEDBACK_SCHEMA = "feedback_id bigint, request_id bigint, ts timestamp, user_id bigint, rating int"

# JSON lines keep microseconds and the zone.
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# An empty text and a null stay apart on the way through CSV.
_CSV_WRITE = {"header": "true", "timestampFormat": TIMESTAMP_FORMAT, "nullValue": "\\N", "emptyValue": '""'}
_CSV_READ = {"header": "true", "timestampFormat": TIMESTAMP_FORMAT, "nullValue": "\\N", "emptyValue": ""}


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", TIMESTAMP_FORMAT).json(path)


def stream_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("timestampFormat", TIMESTAMP_FORMAT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def append_log(df: DataFrame, path: str) -> None:
    write_json(df, path, "append")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    options = {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP_FORMAT}
    df.write.mode(mode).options(**options).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**_CSV_WRITE).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV_READ).csv(path)
