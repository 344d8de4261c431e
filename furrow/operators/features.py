"""Profit assembly, mapping conform and lag features on monthly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.functions.calendar import month_of, year_of
from furrow.session import broadcast_if_small

CELL = ["crop_id", "region_id", "period"]


def conform(source: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with their crop, matched on the cleaned lower-case source name."""
    name = F.lower(F.trim("source_name"))
    keys = (
        mapping.select(name.alias("name_key"), "crop_id").groupBy("name_key").agg(F.min("crop_id").alias("crop_id"))
    )
    return source.withColumn("name_key", name).join(broadcast_if_small(keys), "name_key", "left")


def unmapped(source: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source names without a crop, with their row counts."""
    names = source.select(F.lower(F.trim("source_name")).alias("name_key")).groupBy("name_key").count()
    known = mapping.select(F.lower(F.trim("source_name")).alias("name_key")).distinct()
    return names.join(known, "name_key", "left_anti").withColumnRenamed("count", "n_rows")


def assemble_profit(prices: DataFrame, yields: DataFrame, costs: DataFrame) -> DataFrame:
    """revenue = price x yield and profit = revenue - cost per (crop, region, period).

    The three inputs hold one row per cell, so no join key repeats.
    """
    cells = prices.join(yields, CELL).join(costs, CELL)
    revenue = F.col("price") * F.col("yield")
    return cells.select(
        *CELL, "price", "yield", "cost", revenue.alias("revenue"), (revenue - F.col("cost")).alias("profit")
    )


def lag_features(
    series: DataFrame,
    key: Sequence[str],
    value: str = "price",
    lags: Sequence[int] = (1, 3, 12),
    windows: Sequence[int] = (3, 12),
) -> DataFrame:
    """Lags, rolling mean and deviation over earlier rows, growth and calendar parts.

    `series` has one row per key and month `t` with a decimal value, so a window
    partition is as long as the calendar and no longer. A rolling sum is the
    difference of two running sums, exact on decimals and independent of its length.
    """
    order = Window.partitionBy(*key).orderBy("t")
    out = series.withColumn("year", year_of(F.col("t"))).withColumn("month", month_of(F.col("t")))
    for k in lags:
        out = out.withColumn(f"lag_{k}", F.lag(value, k).over(order))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    square = F.col(value) * F.col(value)
    running = {"_n": F.count(value), "_sum": F.sum(value), "_squares": F.sum(square)}
    for name, column in running.items():
        out = out.withColumn(name, F.coalesce(column.over(past), F.lit(0)))
    for k in windows:
        n, total, squares = (
            F.col(name) - F.coalesce(F.lag(name, k).over(order), F.lit(0)) for name in running
        )
        out = out.withColumn(f"mean_{k}", exact.ratio(total, n)).withColumn(
            f"std_{k}", exact.sample_std(n, total, squares)
        )
    out = out.drop(*running)
    previous = exact.wide(F.lag(value, 1).over(order))
    return out.withColumn("growth", F.try_divide(exact.wide(F.col(value)) - previous, previous))


def profit_rollup(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Revenue, cost and profit for every level of rollup(by); totals show as 'ALL', null keys as '(none)'.

    Cells are combined to the finest level first; only those groups are multiplied.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in by]
    fine = cells.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost")
    )
    totals = fine.rollup(*by).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n_cells").alias("n_cells"), F.sum("revenue").alias("r"), F.sum("cost").alias("c")
    )
    return totals.select(
        *[F.coalesce(F.col(c), F.lit("ALL")).alias(c) for c in by],
        "level",
        "n_cells",
        exact.wide(F.col("r")).alias("revenue"),
        exact.wide(F.col("c")).alias("cost"),
        exact.wide(F.col("r") - F.col("c")).alias("profit"),
    )
