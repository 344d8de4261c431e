"""Isotonic calibration by convex hulls: values are slopes of the greatest convex minorant.

Over the scores in ascending order, (rows so far, positives so far) is a path from the
origin. The lower convex hull of that path has rising slopes, and the slope above a score
is its isotonic value. Hulls of score ranges are built apart and merged pairwise; all
arithmetic is on whole numbers, so the result does not depend on the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.operators.order import running_totals
from furrow.session import broadcast_if_small, persist_reliably

SCORES_PER_SLICE = 1_000_000
BLOCKS = "first double, last double, n bigint, n_pos bigint"

# An edge of a hull: first and last score, rows, positives.
Edge = tuple[float, float, int, int]


def _add(hull: list[Edge], edge: Edge) -> None:
    """Append an edge and join edges until slopes rise again."""
    hull.append(edge)
    # n_pos / n of the last but one against the last, by cross products of whole numbers.
    while len(hull) > 1 and hull[-2][3] * hull[-1][2] >= hull[-1][3] * hull[-2][2]:
        _, last, n, n_pos = hull.pop()
        first, _, n0, n_pos0 = hull.pop()
        hull.append((first, last, n0 + n, n_pos0 + n_pos))


def _columns(hull: list[Edge]) -> list[pa.Array]:
    values = list(zip(*hull)) or [(), (), (), ()]
    return [pa.array(v, t) for v, t in zip(values, (pa.float64(), pa.float64(), pa.int64(), pa.int64()))]


def _builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hull of one slice, whose scores come in order."""
    hull: list[Edge] = []
    number = 0
    for batch in batches:
        for score, n, n_pos, number in zip(*(batch[c].to_pylist() for c in ("score", "n", "n_pos", "slice"))):
            _add(hull, (score, score, n, n_pos))
    yield pa.RecordBatch.from_arrays([*_columns(hull), pa.array([number] * len(hull), pa.int64())], ["first", "last", "n", "n_pos", "slice"])


def _merge(key: tuple, edges: pa.Table) -> pa.Table:
    hull: list[Edge] = []
    edges = edges.sort_by("first")
    for edge in zip(*(edges[c].to_pylist() for c in ("first", "last", "n", "n_pos"))):
        _add(hull, edge)
    return pa.Table.from_arrays([*_columns(hull), pa.array([key[0].as_py()] * len(hull), pa.int64())], names=["first", "last", "n", "n_pos", "slice"])


def _merged(hulls: DataFrame) -> DataFrame:
    """One hull for every two neighbouring ones.

    Only edges whose slopes overlap move: left ones above the right hull's least slope and
    right ones below the left hull's largest. The others stay edges whatever happens.
    """
    slope = exact.wide(F.col("n_pos")) / exact.wide(F.col("n"))
    placed = hulls.select("first", "last", "n", "n_pos", F.floor(F.col("slice") / 2).alias("slice"), (F.col("slice") % 2).alias("side"), slope.alias("slope"))
    facts = placed.groupBy("slice").agg(F.min(F.when(F.col("side") == 1, F.col("slope"))).alias("low"), F.max(F.when(F.col("side") == 0, F.col("slope"))).alias("high"))
    known = placed.join(broadcast_if_small(facts), "slice")
    # A margin for the rounding of slopes; without a partner nothing overlaps.
    overlap = F.when(F.col("side") == 0, F.col("slope") >= F.col("low") - 1e-9).otherwise(F.col("slope") <= F.col("high") + 1e-9)
    known = known.withColumn("moves", F.coalesce(overlap, F.lit(False)))
    rest = known.filter("not moves").select("first", "last", "n", "n_pos", "slice")
    met = known.filter("moves").select("first", "last", "n", "n_pos", "slice").groupBy("slice").applyInArrow(_merge, f"{BLOCKS}, slice bigint")
    return rest.unionByName(met)


def isotonic_blocks(counts: DataFrame, slices: int | None = None) -> DataFrame:
    """Blocks of the isotonic fit of (score, n, n_pos): first and last score, n, n_pos and probability.

    Rows with a null score or one that is no number are left out; scores need not be
    rounded. The table of counts has one row per distinct score. No counts give no
    blocks. `slices` is the number of score ranges, by default one per million scores.
    """
    counts = persist_reliably(counts.select(F.col("score").cast("double").alias("score"), "n", "n_pos").filter("score is not null and not isnan(score)"))
    slices = slices or max(1, -(-counts.count() // SCORES_PER_SLICE))
    placed = counts.repartitionByRange(slices, "score").sortWithinPartitions("score")
    placed = placed.withColumn("slice", F.spark_partition_id().cast("bigint"))
    hulls = persist_reliably(placed.mapInArrow(_builder, f"{BLOCKS}, slice bigint"))
    left = slices
    while left > 1:
        hulls = persist_reliably(_merged(hulls))
        left = -(-left // 2)
    return hulls.select("first", "last", "n", "n_pos", exact.ratio(F.col("n_pos"), F.col("n")).alias("probability"))


def apply_blocks(scored: DataFrame, blocks: DataFrame, key: str = "score") -> DataFrame:
    """`scored` with `probability`: the value of the score's block, on a line between two blocks, the end value beyond them.

    `key` must be unique and not null in `scored`; without blocks probabilities are null.
    Scores find their block by a running count of blocks begun, so neither side is
    gathered or broadcast unmeasured.
    """
    starts = blocks.select(F.col("first").alias(key), F.lit(0).alias("_kind"), F.lit(1).cast("bigint").alias("_begins"))
    points = scored.select(F.col(key), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_begins"))
    counted = persist_reliably(running_totals(starts.unionByName(points), [key, "_kind"], {"_begun": "_begins"}))
    ranks = counted.filter("_kind = 0").select(F.col(key).alias("first"), (F.col("_begun") + 1).alias("_rank"))
    ranked = persist_reliably(blocks.select("first", "last", "probability").join(ranks, "first").select("_rank", "first", "last", "probability"))
    side = lambda name, shift: broadcast_if_small(ranked.select((F.col("_rank") + shift).alias("_begun"), F.struct("first", "last", "probability").alias(name)))
    joined = counted.filter("_kind = 1").select(key, "_begun").join(side("below", 0), "_begun", "left").join(side("above", -1), "_begun", "left")
    share = (F.col(key) - F.col("below.last")) / (F.col("above.first") - F.col("below.last"))
    between = F.col("below.probability") + share * (F.col("above.probability") - F.col("below.probability"))
    value = (
        F.when(F.col("below").isNull(), F.col("above.probability"))
        .when((F.col(key) <= F.col("below.last")) | F.col("above").isNull(), F.col("below.probability"))
        .otherwise(between)
    )
    return scored.join(joined.select(key, value.alias("probability")), key)
