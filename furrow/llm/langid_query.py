"""Query op7_langid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.langid import predict, train
from furrow.llm.registry import query
from furrow.sources.tables import table

REMAINDERS = 3


@query("op7_langid")
def op7_langid(spark: SparkSession, base: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % REMAINDERS == 1
    docs = table(spark, base, "documents")
    model = train(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
