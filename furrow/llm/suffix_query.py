"""Query op2_suffix_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm.registry import query
from furrow.llm.suffix_dedup import remove_repeats
from furrow.sources.tables import table


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, base: str) -> DataFrame:
    return remove_repeats(table(spark, base, "documents")).drop("kept")
