"""From raw documents to packed sequences in five stages.

Each stage reads what its predecessor kept, written as Parquet; all but the last return
the columns of `documents`. In every stage an empty table gives an empty table, null ids
and other nulls are no reason to lose a row, whole texts count whatever their length, and
further columns stay as they came, whatever their names. What a stage does with repeated
rows, ties, null and empty texts is said with it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.decontaminate import without_items
from furrow.llm.jaccard_join import keep_one
from furrow.llm.packing import pack
from furrow.llm.pii import redact
from furrow.llm.registry import query
from furrow.llm.toxicity import score, train
from furrow.session import configure, persist_reliably
from furrow.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the model learns from the labels of these documents.

    A score depends on the text alone, so repeated rows stay or go together; a null or
    empty text has the score of an empty one. A document scored one half goes, unless no
    label has been learned from: then every score is one half and all stay.
    """
    configure(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    out = next(name for i in range(len(docs.columns) + 1) if (name := f"toxicity{i}") not in docs.columns)
    kept = F.col(out) < 0.5 if model.trees.nodes else F.lit(True)
    return score(docs, model, out).filter(kept).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    That with the smallest id stays, and one of its repeated rows. Texts below five words
    are one shingle. Null texts, texts without words and rows without an id all stay.
    """
    configure(spark)
    return keep_one(docs, percent=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Repeated rows stay or go together, and null and empty texts hold nothing. Items of
    fewer than five words have no shingle and are not looked for.
    """
    configure(spark)
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by marks; n_chars follows the text.

    Every row stays, repeated rows too. Null texts stay null with their n_chars as it was.
    """
    configure(spark)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens.

    Every row is a document of its own, repeated rows and equal ids included; a null or
    empty text is its end id. Other columns than doc_id and text end here.
    """
    configure(spark)
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

# Trained models and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = persist_reliably(docs)
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, base: str) -> DataFrame:
    return run(spark, base)
