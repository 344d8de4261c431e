"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import persist_reliably, release


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step: each node hands its larger (or smaller) neighbours to its smallest one."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return moved.filter("a <> b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either a centre or linked with one centre only."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("out")))
    odd = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least")).filter("out > 1 or out > 0 and least = 0")
    return odd.agg(F.count(F.lit(1)).alias("n")).first().n == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node.

    Nulls and links of a node with itself are left out; direction and repeats do not
    matter; no links give no rows. The result is a table of its own. Hubs are handled by aggregates and joins, never by
    collected neighbour lists.
    """
    now = persist_reliably(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(now):
        now, old = persist_reliably(_stars(_stars(now, True), False)), now
        release(old)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = persist_reliably(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
    release(now)
    return found
