"""Benchmark decontamination: which documents contain which test items.

Size-partitioned MinHash containment search. Items are partitioned by their number of
shingles; each partition keeps, for each item, its k smallest shingle hashes, with k
such that a document with the wanted share of any item of that size must hold at
least one of them. A document of any length is thus found by looking its shingles up in
these sketches, and no signature of the long document is needed. Found pairs are
verified by counting the item's distinct shingles in the document. All of it is
DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import broadcast_if_small, persist_reliably

SIZE = 5
PERCENT = 80


def words(text: Column) -> Column:
    """Words of a text: runs of characters other than space and \\t..\\r, with A-Z lower-cased."""
    spaced = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.array_remove(F.split(spaced, " "), "")


def shingle_rows(table: DataFrame, size: int, *keys: str) -> DataFrame:
    """A row (keys, shingle) for each run of `size` words; texts with fewer words have none. The shingle is a 64-bit hash."""
    count = F.greatest(F.size("words") - (size - 1), F.lit(0))
    runs = [F.slice("words", i + 1, count).alias(f"w{i}") for i in range(size)]
    listed = table.select(*keys, F.inline(F.arrays_zip(*runs)))
    return listed.select(*keys, F.xxhash64(*(f"w{i}" for i in range(size))).alias("shingle"))


def item_shingles(items: DataFrame, size: int) -> DataFrame:
    """Distinct shingles of each item, with the item's number of them."""
    split = items.select("item_id", words(F.col("text")).alias("words"))
    rows = shingle_rows(split, size, "item_id").distinct()
    sizes = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, "item_id")


def sketches(shingles: DataFrame, percent: int) -> DataFrame:
    """The k smallest hashes of each item; k comes from the item's size partition (powers of two)."""
    top = F.pow(F.lit(2), F.floor(F.log2(F.col("n"))) + 1) - 1
    # An item of n shingles may miss n - ceil(percent * n / 100) of them.
    missing = F.floor(top * (100 - percent) / 100)
    ranked = shingles.groupBy("item_id", "n").agg(F.sort_array(F.collect_list("shingle")).alias("all"))
    return ranked.select("item_id", "n", F.explode(F.slice("all", 1, (missing + 1).cast("int"))).alias("shingle"))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) where a document holds percent/100 or more of an item's distinct shingles.

    Reads doc_id, text and item_id, text; other columns are left aside. Null or empty
    texts and items with fewer than `size` words match nothing; rows with a null id are
    left out, as a pair could not name them. Rows of one table with equal ids count as
    one text each for its own shingles and are joined per id: shingles of all its rows
    count. Repeated rows give one result row. Empty tables give no rows.

    Items are a lookup side: broadcast while their measured size allows, joined by
    shuffle beyond. Documents are never compared with each other.
    """
    items = persist_reliably(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    all_items = persist_reliably(item_shingles(items, size))
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    probes = broadcast_if_small(sketches(all_items, percent).select("shingle").distinct())
    found = shingle_rows(split, size, "doc_id").join(probes, "shingle", "left_semi").select("doc_id").distinct()
    candidates = persist_reliably(found)
    # Verification: all shingles of the documents that hold any sketched one.
    wanted = split.join(broadcast_if_small(candidates), "doc_id", "left_semi")
    held = shingle_rows(wanted, size, "doc_id").join(broadcast_if_small(all_items), "shingle").select("doc_id", "item_id", "n", "shingle").distinct()
    counted = held.groupBy("doc_id", "item_id").agg(F.first("n").alias("n_item"), F.count(F.lit(1)).alias("n_shared"))
    return counted.filter(F.lit(100) * F.col("n_shared") >= F.lit(percent) * F.col("n_item"))


def without_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """`docs` without the documents that contain an item; rows with a null doc_id stay."""
    hits = persist_reliably(contained_items(docs, items, percent, size).select("doc_id").distinct())
    return docs.join(broadcast_if_small(hits), "doc_id", "left_anti").select(*docs.columns)
