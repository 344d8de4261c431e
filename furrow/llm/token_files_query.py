"""Query op12_token_files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.registry import query
from furrow.llm.token_files import read_tokens, write_tokens
from furrow.sources.tables import table


@query("op12_token_files")
def op12_token_files(spark: SparkSession, base: str) -> DataFrame:
    place = write_tokens(table(spark, base, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, place).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
