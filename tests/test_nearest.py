import random

import pytest

from furrow.operators.nearest import nearest_names
from furrow.operators.series import gap_free, month_lags


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def names(spark, rows):
    return spark.createDataFrame([(r, "x") for r in rows], "name string, candidate string")


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_candidates_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    make = lambda: "".join(rng.choice("abü ") for _ in range(rng.randint(0, 9)))
    known = [make() for _ in range(80)] + ["", "a", "maize corn", "spring wheat of the old sort", None, None]
    unknown = [make() for _ in range(120)] + ["", "mais corn", "spring wheat of old sort", None, "spring wheat", "spring wheat"]
    got = sorted((r.name, r.candidate, r.distance) for r in nearest_names(names(spark, unknown), names(spark, known), distance).collect())
    want = sorted((u, k, d) for u in {*unknown} - {None} for k in {*known} - {None} if (d := edits(u, k)) <= distance)
    assert got == want


def test_many_names_with_one_segment(spark):
    known = [f"winter barley {i:03d}" for i in range(300)]
    got = nearest_names(names(spark, ["winter barley 1234"]), names(spark, known), 1).collect()
    assert {r.candidate for r in got} == {"winter barley 123", "winter barley 124", "winter barley 134", "winter barley 234"}
    assert nearest_names(names(spark, known).limit(0), names(spark, known)).count() == 0
    with pytest.raises(ValueError):
        nearest_names(names(spark, known), names(spark, known), -1)


def test_gaps_are_filled_and_lags_go_by_month(spark):
    rows = [("a", 10, 1.0), ("a", 13, 7.0), ("a", 14, None), ("a", 15, 3.0), ("b", 3, 5.0), (None, 1, 2.0), (None, 3, 4.0), ("c", 9, None)]
    dense = gap_free(spark.createDataFrame(rows, "k string, t int, value double"), ["k"])
    got = {(r.k, r.t): (r.observed, r.last_value, r.interpolated) for r in dense.collect()}
    assert got == {
        ("a", 10): (True, 1.0, 1.0), ("a", 11): (False, 1.0, 3.0), ("a", 12): (False, 1.0, 5.0), ("a", 13): (True, 7.0, 7.0), ("a", 14): (False, 7.0, 5.0),
        ("a", 15): (True, 3.0, 3.0), ("b", 3): (True, 5.0, 5.0), (None, 1): (True, 2.0, 2.0), (None, 2): (False, 2.0, 3.0), (None, 3): (True, 4.0, 4.0),
    }
    lags = {(r.k, r.t): r.month_lag_3 for r in month_lags(dense, ["k"], [3]).collect()}
    assert lags["a", 13] == 1.0 and lags["a", 15] == 5.0 and lags["a", 12] is None
