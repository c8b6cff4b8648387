"""Queries against their SQL on the driver's smallest tables, and what a plan must look like."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from basalt.plans import bridge, catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
NAMES = ["f_blocks", "f_transactions", "f_inputs", "f_outputs", "ds_blocks", "ds_inputs", "g07_chain_linkage_internal", "g20_foreign_input_references", "g26_fee_arithmetic_matches", "g33_outputs_unspent_within_window", "gate_severity", "m02_fees_by_block", "m07_spent_share", "m11_highest_fee_rates", "e06_sample_inputs", "e09_by_block", "w_core_transaction_outputs", "t_relationships_outputs_transactions", "x_upsert_merge", "x_incremental_plan", "x_json_props"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_like_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = lambda data, cols: Counter(tuple(_plain(r[cols.index(c)]) for c in sorted(cols)) for r in data)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_every_query_has_sql():
    q, o = catalogue.queries(), catalogue.oracle_sql()
    assert set(q) == set(o) and len(q) > 100
    assert set(q) <= set(entry.queries()) and set(o) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["block_height", "total_fees_sats", "avg_fee_rate_sats_per_vbyte"] and df.count() > 70


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_cartesian_product(spark):
    w = bridge.ledger_of(spark, SF, "dirty").window(0, 79)
    from basalt.operators.checks import CHECKS

    for c in CHECKS:
        plan = _plan(c.rows(w))
        assert "CartesianProduct" not in plan and "Python" not in plan and "BroadcastNestedLoopJoin" not in plan, c.id


def test_row_checks_are_one_pass(spark):
    from basalt.operators.checks import CHECKS
    from basalt.plans import gate

    w = bridge.ledger_of(spark, SF).window(0, 79)
    n = {c.number for c in CHECKS if c.dataset}
    assert len(n) == 12
    scans = gate.counts(w).where("check_number in (27, 28, 29)")
    assert scans.count() == 3
