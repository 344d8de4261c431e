"""Log lines that do not fit: told apart from good ones with file and reason, in batch and in streams.

Every line read comes out exactly once, as a typed record or as a rejected line. In a
stream each batch writes both into folders of its own and then one ledger entry; readers
see only batches that the ledger names, so a batch that stopped half-way is not seen and
is replaced when it is tried again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow.sources.logs import TIMESTAMP_FORMAT, write_json

LEDGER = "query string, file string, lines bigint, good bigint, rejected bigint, batch bigint"
REJECTED = "file string, reason string, line string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of every line of text files."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def judge(lines: DataFrame, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """(file, line) with `record`, typed by `schema`, and `reason`, null for good lines.

    A line is blank, broken (no JSON, more than one record, or one key twice), not an object, mistyped (the
    first field whose value does not fit its type) or incomplete (the first of `required`
    that is missing or null). Fields that the schema does not name are left aside.
    """
    fields = StructType.fromDDL(schema)
    found = F.try_parse_json("line")
    record = F.from_json("line", fields, {"timestampFormat": TIMESTAMP_FORMAT})
    judged = lines.select("file", "line", found.alias("_found"), record.alias("record"))
    blank = F.col("line").isNull() | (F.trim(F.translate("line", "\t\r", "  ")) == "")
    # As the only entry of a list: two records on one line are more than one entry, or none.
    alone = F.json_array_length(F.concat(F.lit("["), "line", F.lit("]"))).eqNullSafe(F.lit(1))
    reasons = [F.when(blank, "blank"), F.when(F.col("_found").isNull() | ~alone, "broken"), F.when(~F.startswith(F.schema_of_variant("_found"), F.lit("OBJECT")), "not an object")]
    for name in fields.names:
        given = F.try_variant_get(F.col("_found"), f'$["{name}"]', "string").isNotNull()
        reasons.append(F.when(given & F.col("record")[name].isNull(), f"mistyped {name}"))
    reasons += [F.when(F.col("record")[name].isNull(), f"missing {name}") for name in required]
    return judged.select("file", "line", "record", F.coalesce(*reasons).alias("reason"))


def split_log(lines: DataFrame, schema: str, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Typed records with their `file`, and rejected lines as (file, reason, line)."""
    judged = judge(lines, schema, required)
    return _good(judged), _rejected(judged)


def _good(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is null").select("file", "record.*")


def _rejected(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is not null").select("file", "reason", "line")


def _ledger_entry(spark: SparkSession, root: str, epoch: int) -> str | None:
    """The query that wrote a batch, if the ledger has it."""
    place = f"{root}/ledger/batch={epoch}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    first = spark.read.schema(LEDGER).parquet(place).select("query").first()
    return first.query if first else None


def routed_sink(root: str, schema: str, required: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Writer of a line stream's batches below `root`: good/, rejected/ and then ledger/, one folder per batch.

    A repeated batch of the same query replaces its own folders. A query that comes with
    batch numbers another query has entered, as after a lost checkpoint, is refused: it
    would read the same lines anew and write over earlier ones.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        known = _ledger_entry(spark, root, epoch)
        if known not in (None, query):
            raise ValueError(f"batch {epoch} below {root} was written by query {known}")
        # Kept for three outputs: the lines are read and parsed once per batch.
        judged = judge(batch, schema, required).persist()
        try:
            write_json(_good(judged), f"{root}/good/batch={epoch}")
            write_json(_rejected(judged), f"{root}/rejected/batch={epoch}")
            counts = judged.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reason").isNull()).alias("good"), F.count("reason").alias("rejected"))
            counts.select(F.lit(query).alias("query"), "*").write.mode("overwrite").parquet(f"{root}/ledger/batch={epoch}")
        finally:
            judged.unpersist()

    return write


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(query, file, lines, good, rejected, batch) of every finished batch; lines = good + rejected."""
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger")


def read_routed(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records and rejected lines of the batches in the ledger, each with its `batch`."""
    # One row per batch prunes the folders that are read.
    finished = F.broadcast(ledger(spark, root).select("batch").distinct())
    options = {"timestampFormat": TIMESTAMP_FORMAT}
    good = spark.read.schema(f"file string, {schema}, batch bigint").options(**options).json(f"{root}/good")
    rejected = spark.read.schema(f"{REJECTED}, batch bigint").json(f"{root}/rejected")
    return tuple(frame.join(finished, "batch", "left_semi") for frame in (good, rejected))
