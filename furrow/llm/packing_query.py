"""Query op1_packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.packing import pack
from furrow.llm.registry import query
from furrow.sources.tables import table


@query("op1_packing")
def op1_packing(spark: SparkSession, base: str) -> DataFrame:
    pieces = pack(table(spark, base, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
