"""Longest-prefix path rewriting against a rule table of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import paths
from furrow.session import BROADCAST_BYTES, measure


def distinct_rules(rules: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Normalise rules and keep one per (scope, old): the lowest `ord` wins."""
    tidy = rules.select(
        *scope,
        paths.normalize_prefix(F.col("old")).alias("old"),
        paths.normalize_prefix(F.col("new")).alias("new"),
        "ord",
    ).filter(F.col("old") != "")
    return (
        tidy.groupBy(*scope, "old")
        .agg(F.min(F.struct("ord", "new")).alias("first"))
        .select(
            *scope,
            "old",
            F.col("first.new").alias("new"),
            F.size(paths.components(F.col("old"))).alias("depth"),
        )
    )


def rewrite_by_rule_table(
    df: DataFrame,
    text: str,
    rules: DataFrame,
    out: str = "rewritten",
    rule_out: str = "matched_rule",
    scope: Sequence[str] = (),
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rewrite `text` by its longest matching rule.

    A path of n parts can match a rule of depth d only through its first d parts,
    so each rule depth is one equality join on that leading piece. There are as
    many joins as rule depths (a handful), no pair blow-up and no regrouping of
    rows. Small rule tables are broadcast and the rows never move.
    """
    table, known = measure(distinct_rules(rules, scope), F.sort_array(F.collect_set("depth")).alias("depths"))
    depths = known.depths
    result = df.withColumn("_parts", paths.components(paths.normalize_separators(F.col(text))))
    hits = []
    for depth in reversed(depths):
        key, hit = f"_key{depth}", f"_hit{depth}"
        side = table.filter(F.col("depth") == depth).select(
            *[F.col(c).alias(f"_{c}{depth}") for c in scope],
            F.col("old").alias(key),
            F.struct("old", "new").alias(hit),
        )
        if known.size <= max_bytes:
            side = F.broadcast(side)
        lead = F.when(
            F.size("_parts") >= depth, F.array_join(F.slice("_parts", 1, depth), "/")
        )
        match = lead == F.col(key)
        if known.size > max_bytes:
            # Shorter paths match nothing; null keys would all be dealt to one partition.
            apart = F.concat(F.lit("/"), F.xxhash64(text).cast("string"))
            match = (F.coalesce(lead, apart) == F.col(key)) & (F.size("_parts") >= depth)
        for name in scope:
            match = match & (F.col(name) == F.col(f"_{name}{depth}"))
        result = result.join(side, match, "left").drop(
            key, *[f"_{c}{depth}" for c in scope]
        )
        hits.append(F.col(hit))
    best = F.coalesce(*hits) if hits else F.lit(None).cast("struct<old:string,new:string>")
    return (
        result.withColumn("_best", best)
        .withColumn(out, paths.apply_rule(F.col(text), F.col("_best.old"), F.col("_best.new")))
        .withColumn(rule_out, F.col("_best.old"))
        .drop("_parts", "_best", *[f"_hit{d}" for d in depths])
    )

