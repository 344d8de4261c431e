"""Query op9_html_text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.registry import query
from furrow.llm.site_templates import main_texts
from furrow.sources.tables import table


@query("op9_html_text")
def op9_html_text(spark: SparkSession, base: str) -> DataFrame:
    return main_texts(table(spark, base, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
