"""Shapes of physical plans, and every registered query against its SQL at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import TABLES, rows_of

BASE = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{BASE}/{name}.parquet'")
    return con


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, BASE)
    plan = plan_of(frame)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    rows = rows_of(frame.columns, frame.collect())
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows == rows_of(columns, cursor.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["recommend_topk"](spark, BASE))
    assert plan.count("WindowGroupLimit") == 2


def test_rule_table_rewrite_moves_no_rows(spark):
    plan = plan_of(QUERIES["path_prefix_rewrite"](spark, BASE))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_flatten_is_one_stage(spark):
    from furrow.operators.payload import flatten_json

    frame = spark.createDataFrame([(1, '{"a":1}')], "id int, document string")
    plan = plan_of(flatten_json(frame, "document", ["id"]))
    assert "Exchange" not in plan and plan.count("Generate") == 1


def test_scan_reads_only_what_it_needs(spark):
    plan = plan_of(QUERIES["training_samples"](spark, BASE))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)" in plan
    plan = plan_of(QUERIES["trend_forecast"](spark, BASE))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
