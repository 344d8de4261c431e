"""Query op3_toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.registry import query
from furrow.llm.toxicity import score, train
from furrow.sources.tables import table

REMAINDERS = 5


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, base: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % REMAINDERS
    docs = table(spark, base, "documents").select("doc_id", "text")
    labels = table(spark, base, "labels").filter(remainder != 0)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
