"""Month arithmetic shared by the series operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(moment: Column) -> Column:
    """Whole months since January 1970."""
    return (F.year(moment) - 1970) * 12 + F.month(moment) - 1


def year_of(index: Column) -> Column:
    return (F.floor(index / 12) + 1970).cast("int")


def month_of(index: Column) -> Column:
    return (F.pmod(index, F.lit(12)) + 1).cast("int")


def month_label(index: Column) -> Column:
    return F.concat(year_of(index).cast("string"), F.lit("-"), F.lpad(month_of(index).cast("string"), 2, "0"))
