"""Query op4_quality_rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.quality_cascade import judge
from furrow.llm.registry import query
from furrow.sources.tables import table


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    judged = judge(table(spark, base, "documents"))
    kept = F.when(F.col("base_failed"), False).otherwise(F.col("rejected_by").isNull())
    return judged.withColumn("kept", kept).drop("rejected_by")
