"""Distributed global ranks and running totals: no single-task window over the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import persist_reliably

_POSITION_MASK = (1 << 33) - 1


def _slice_count(df: DataFrame, slices: int | None) -> int:
    return slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_row_number(
    df: DataFrame, order: Sequence[Column], out: str = "rank", slices: int | None = None
) -> DataFrame:
    """Row number over the whole table; `order` must end in a unique key.

    The unique tail lets the range partitioner cut through any run of equal
    leading values. Only one count per slice is combined centrally.
    """
    placed = (
        df.repartitionByRange(_slice_count(df, slices), *order)
        .sortWithinPartitions(*order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))
    )
    placed = persist_reliably(placed)
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_slice")
        .withColumn(out, F.col("_offset") + F.col("_pos") + 1)
        .drop("_slice", "_pos", "_offset")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    values: Mapping[str, str],
    slices: int | None = None,
) -> DataFrame:
    """Totals of all strictly earlier rows, for each `values[name] -> column`.

    `order` must be a unique key of `df`.
    """
    placed = persist_reliably(
        df.repartitionByRange(_slice_count(df, slices), *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    sums = placed.groupBy("_slice").agg(
        *[F.sum(column).alias(f"_{name}") for name, column in values.items()]
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_slice",
        *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in values],
    )
    inside = (
        Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = placed.join(F.broadcast(offsets), "_slice")
    for name, column in values.items():
        joined = joined.withColumn(
            name, F.coalesce(F.sum(column).over(inside), F.lit(0)) + F.col(f"_{name}")
        )
    return joined.drop("_slice", *[f"_{name}" for name in values])
