import random

from pyspark.sql import functions as F

from furrow.operators.order import global_row_number, running_totals


def test_rank_over_a_hot_value(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 50)}", i) for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, id int").repartition(5)
    out = global_row_number(frame, [F.col("k"), F.col("id")], slices=7).collect()
    got = sorted((r["rank"], r.k, r.id) for r in out)
    assert [(k, i) for _, k, i in got] == sorted(rows)
    assert [g[0] for g in got] == list(range(1, len(rows) + 1))


def test_rank_of_nothing(spark):
    frame = spark.createDataFrame([], "k string, id int")
    assert global_row_number(frame, [F.col("k"), F.col("id")], slices=3).count() == 0


def test_running_totals(spark):
    rows = [(i, i * 3 % 7) for i in range(500)]
    frame = spark.createDataFrame(rows, "k int, v bigint").repartition(4)
    got = {r.k: r.before for r in running_totals(frame, ["k"], {"before": "v"}, slices=6).collect()}
    total = 0
    for k, v in rows:
        assert got[k] == total
        total += v
