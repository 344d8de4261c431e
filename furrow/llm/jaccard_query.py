"""Query op8_jaccard_join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm.jaccard_join import jaccard_components
from furrow.llm.registry import query
from furrow.sources.tables import table


@query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, base: str) -> DataFrame:
    return jaccard_components(table(spark, base, "documents"))
