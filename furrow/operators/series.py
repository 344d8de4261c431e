"""Chart-ready tables: pivots, subtotals and running totals by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.calendar import month_label


def pivot_by_month(facts: DataFrame, column: str, names: Sequence[str], value: str) -> DataFrame:
    """One row per month `t`, one column per name, plus the total."""
    cells = [F.sum(F.when(F.col(column) == n, F.col(value))).alias(n.lower()) for n in names]
    return (
        facts.groupBy("t")
        .agg(*cells, F.sum(value).alias("total"))
        .select(
            month_label(F.col("t")).alias("month"),
            *[F.coalesce(F.col(n.lower()).cast("double"), F.lit(0.0)).alias(n.lower()) for n in names],
            F.col("total").cast("double").alias("total"),
        )
    )


def running_series(facts: DataFrame, group: str, value: str) -> DataFrame:
    """Monthly value and running total per group; the window sees one row per month."""
    monthly = facts.groupBy(group, "t").agg(F.sum(value).alias("v"))
    order = Window.partitionBy(group).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select(
        group,
        month_label(F.col("t")).alias("month"),
        F.col("v").cast("double").alias("value"),
        F.sum("v").over(order).cast("double").alias("running"),
    )


def subtotals(facts: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str], value: str) -> DataFrame:
    """GROUPING SETS over `columns`; columns outside a set show as 'ALL', null keys as '(none)'."""
    rows = facts.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in columns], value)
    fine = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    grouped = fine.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"), F.sum("v").alias("v")
    )
    return grouped.select(
        *[F.coalesce(F.col(c), F.lit("ALL")).alias(c) for c in columns],
        "level",
        "n",
        F.col("v").cast("double").alias("value"),
    )


def gap_free(series: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Every month from a key's first to its last: (key, t, observed, last_value, interpolated).

    `series` has one row per key and month `t`; rows with a null value count as gaps, and
    keys without any value drop out. A gap carries the value before it and a point on the
    straight line to the value after it. Each known month writes out the months up to the
    next one, so no calendar is joined and only known months are sorted.
    """
    order = Window.partitionBy(*key).orderBy("t")
    known = series.filter(F.col(value).isNotNull()).select(*key, "t", F.col(value).alias("_v"))
    known = known.withColumns({"_next_t": F.lead("t").over(order), "_next_v": F.lead("_v").over(order)})
    months = F.sequence(F.col("t"), F.coalesce(F.col("_next_t") - 1, F.col("t")))
    rows = known.select("*", F.explode(months).alias("_t"))
    low, high = F.col("_v").cast("double"), F.col("_next_v").cast("double")
    share = (F.col("_t") - F.col("t")).cast("double") / (F.col("_next_t") - F.col("t")).cast("double")
    observed = F.col("_t") == F.col("t")
    return rows.select(
        *key,
        F.col("_t").alias("t"),
        observed.alias("observed"),
        F.col("_v").alias("last_value"),
        F.when(observed, low).otherwise(low + share * (high - low)).alias("interpolated"),
    )


def month_lags(dense: DataFrame, key: Sequence[str], lags: Sequence[int], value: str = "interpolated") -> DataFrame:
    """Values so many months before, from a gap-free series: a row is a month, so rows back are months back."""
    order = Window.partitionBy(*key).orderBy("t")
    return dense.withColumns({f"month_lag_{k}": F.lag(value, k).over(order) for k in lags})
