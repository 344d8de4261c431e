"""Range matching in several factors: boxes on a grid whose cells fit each box.

A profile is a box of ranges. In every factor it is cut by cells of the least power of two
that is no smaller than its range, so it touches two cells at most there, however wide it
is: 2 ** factors rows per profile at most. A request lies in one cell of each cell shape
that profiles use, and meets a profile by equality in exactly one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from furrow.session import broadcast_if_small, persist_reliably

# Exponents of cell sizes: finer and coarser cells are not told apart, `WHOLE` is one cell for all.
FINEST, COARSEST, WHOLE = -16, 60, 61
# Requests are looked up once per shape of cells, so shapes are made coarser until they are no more.
MOST_SHAPES = 64


def _exponent(low: Column, high: Column, step: int) -> Column:
    """Exponent of the cell size for a range, a multiple of `step`."""
    width = high - low
    needed = F.ceil(F.log2(F.greatest(width, F.lit(2.0**FINEST))))
    rounded = (F.ceil(F.greatest(needed, F.lit(FINEST)) / step) * step).cast("int")
    open_ended = F.isnan(width) | (width > 2.0**COARSEST) | (rounded > COARSEST)
    return F.when(open_ended, F.lit(WHOLE)).otherwise(rounded)


def _cell(value: Column, exponent: Column) -> Column:
    """Number of the cell a value lies in; beyond the range of a long the outermost one."""
    scaled = F.greatest(F.least(value / F.pow(F.lit(2.0), exponent.cast("double")), F.lit(2.0**62)), F.lit(-(2.0**62)))
    return F.when(exponent == WHOLE, F.lit(0).cast("bigint")).otherwise(F.floor(scaled))


def _shapes(profiles: DataFrame, factors: Sequence[str]) -> tuple[DataFrame, list[Row]]:
    """Profiles with one exponent per factor, and the distinct combinations of these."""
    # At the last step each factor has three shapes at most.
    step, most = 1, max(MOST_SHAPES, 3 ** len(factors))
    while True:
        shaped = profiles.withColumns({f"_e_{f}": _exponent(F.col(f"{f}_lo").cast("double"), F.col(f"{f}_hi").cast("double"), step) for f in factors})
        shapes = shaped.select(*[f"_e_{f}" for f in factors]).distinct().limit(most + 1).collect()
        if len(shapes) <= most:
            return shaped, shapes
        step *= 2


def inside_boxes(requests: DataFrame, profiles: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Requests with the columns of every profile whose ranges hold all their factors.

    Profiles have `<factor>_lo` and `<factor>_hi`, both ends included, infinite ones
    allowed. Empty ranges and bounds that are null or no number match nothing, and so do
    such factors of a request. Repeated rows match one by one.
    """
    names = {f: (F.col(f"{f}_lo").cast("double"), F.col(f"{f}_hi").cast("double")) for f in factors}
    known = reduce(lambda a, b: a & b, [low.isNotNull() & high.isNotNull() & ~F.isnan(low) & ~F.isnan(high) & (low <= high) for low, high in names.values()])
    shaped, shapes = _shapes(persist_reliably(profiles.filter(known)), factors)
    for f, (low, high) in names.items():
        first, last = (_cell(end, F.col(f"_e_{f}")) for end in (low, high))
        # Rounding may put the ends of a range into cells that are not neighbours; those between belong to it too.
        shaped = shaped.withColumn(f"_c_{f}", F.explode(F.sequence(first, last)))
    keys = [f"_{kind}_{f}" for f in factors for kind in ("e", "c")]
    values = {f: F.col(f).cast("double") for f in factors}
    fits = reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) for v in values.values()])
    if not shapes:
        return requests.join(shaped.drop(*keys), F.lit(False))
    listed = F.array(*[F.struct(*[F.lit(shape[f"_e_{f}"]).alias(f"_e_{f}") for f in factors]) for shape in shapes])
    placed = requests.filter(fits).select("*", F.inline(listed))
    placed = placed.withColumns({f"_c_{f}": _cell(v, F.col(f"_e_{f}")) for f, v in values.items()})
    inside = reduce(lambda a, b: a & b, [values[f].between(*names[f]) for f in factors])
    return placed.join(broadcast_if_small(shaped), keys).filter(inside).drop(*keys)
