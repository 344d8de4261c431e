"""Session settings, the shared work folder and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when an aggregate on the same key sits above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows that go to Python may carry whole texts, so batches stay small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

BROADCAST_BYTES = 64 * 1024 * 1024
# Garbage is collected for the sake of shuffle files no more often than this.
COLLECT_SECONDS = 3.0
_collected = 0.0


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on; sizes stay the cluster's."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "furrow") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", "8g")
    )
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        # Only single-machine runs such as tests may leave the setting empty.
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="furrow-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the application's part of the shared folder."""
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/furrow/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete what this application wrote below the shared folder; call it when all results are out."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def persist_reliably(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder, so a lost executor costs nothing.

    Unlike a checkpoint the table is columnar: later reads prune columns and the
    planner knows its size.
    """
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def release(*tables: DataFrame | None) -> None:
    """Delete tables of `persist_reliably` that nothing reads any more, and let Spark drop the shuffle files of finished steps.

    Frames that are no such tables are left alone. Only for tables whose readers have all
    been written themselves; a frame that still reads one fails.
    """
    spark = None
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path is not None:
            spark = table.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            table.stored_at = None
    global _collected
    if spark is not None and time.monotonic() - _collected > COLLECT_SECONDS:
        # Spark's cleaner follows the garbage collectors of both sides.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def measure(df: DataFrame, *facts: Column) -> tuple[DataFrame, Row]:
    """Materialise a lookup side once; gives it and a row with its `size` in bytes and further `facts`."""
    kept = persist_reliably(df)
    width = sum((F.octet_length(F.col(c).cast("string")) for c in kept.columns), F.lit(0))
    size = F.coalesce(F.sum(F.coalesce(width, F.lit(64)) + 16), F.lit(0))
    return kept, kept.agg(size.alias("size"), *facts).first()


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a lookup side only when its measured size fits.

    Beyond the limit the frame comes back without a hint: Spark then joins by
    shuffle and splits skewed partitions at run time.
    """
    kept, known = measure(df)
    return F.broadcast(kept) if known.size <= max_bytes else kept


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain scan over the cluster when its files give fewer tasks than cores.

    For work that is heavy per row. Large inputs have splits enough and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
