import json

import pytest

from basalt.operators.checks import BOUNDARY, CHECKS, FAIL, PASS, WARN
from basalt.plans import gate, summary

from . import golden


def severities(spark, data, start=100, end=102):
    return {r["check_number"]: r for r in gate.severities(golden.ledger(spark, data).window(start, end)).collect()}


@pytest.fixture(scope="module")
def window(spark):
    return golden.ledger(spark, golden.tables()).window(100, 102)


def test_there_are_33_checks():
    assert [c.number for c in CHECKS] == list(range(1, 34)) and len({c.id for c in CHECKS}) == 33
    by = [c.severity for c in CHECKS]
    assert (by.count(FAIL), by.count(WARN), by.count(BOUNDARY)) == (26, 3, 4)
    assert set(golden.MUTATIONS) == {c.number for c in CHECKS if c.severity != BOUNDARY}


def test_report_of_the_golden_window(window, tmp_path):
    r = gate.validate(window)
    assert r["overall_status"] == PASS and r["severity_totals"] == {PASS: 29, BOUNDARY: 4, WARN: 0, FAIL: 0}
    assert (r["observed_min_height"], r["observed_max_height"], r["expected_block_count"], r["observed_block_count"]) == (100, 102, 3, 3)
    d = {c["id"]: c["details"] for c in r["checks"]}
    assert (d["foreign_input_references"]["internal_count"], d["foreign_input_references"]["foreign_count"]) == (2, 1)
    assert d["foreign_input_references"]["samples"] == [{"txid": "tx100", "input_index": 0, "previous_txid": "foreign"}]
    assert d["fee_arithmetic_matches"]["checkable_transactions"] == 3 and d["outputs_without_standard_address"]["no_address_count"] == 1
    assert r["boundary_metrics"]["first_block_lacks_loaded_predecessor"] == {"block_height": 100, "previous_block_hash": "hash99"}
    assert r["boundary_metrics"]["outputs_unspent_within_window"] == {"count": 5, "pct": 71.43}
    assert r["summary_statistics"]["size_weight_vsize"]["avg_size"] == 225.0
    path = gate.report_path(str(tmp_path), 100, 102)
    gate.write_report(r, path)
    assert json.load(open(path))["overall_status"] == PASS and gate.load_report(str(tmp_path), 100, 102)
    gate.print_report(r)


@pytest.mark.parametrize("number", sorted(golden.MUTATIONS))
def test_one_broken_fact(spark, number):
    """Only the check's own rows are counted here: a job a check, not the whole gate."""
    check = CHECKS[number - 1]
    w = golden.ledger(spark, golden.broken(golden.MUTATIONS[number])).window(100, 102)
    clean = golden.ledger(spark, golden.tables()).window(100, 102)
    assert check.rows(w).count() >= 1 and check.rows(clean).count() == 0


def test_warnings_leave_the_status(spark):
    def change(d):
        golden.MUTATIONS[28](d)
        golden.MUTATIONS[18](d)

    r = gate.validate(golden.ledger(spark, golden.broken(change)).window(100, 102))
    assert r["severity_totals"][WARN] == 2 and r["overall_status"] == PASS


def test_a_duplicate_block_fails_three_checks(spark):
    s = severities(spark, golden.broken(golden.MUTATIONS[3]))
    assert {n for n, r in s.items() if r["severity"] == FAIL} == {2, 3, 4}


def test_a_missing_block_fails_three_checks(spark):
    s = severities(spark, golden.broken(golden.MUTATIONS[1]))
    assert {n for n, r in s.items() if r["severity"] == FAIL} == {1, 7, 10}


def test_nulls_are_no_violation(spark):
    def change(d):
        golden.row(d, "blocks", block_height=101)["previous_block_hash"] = None
        golden.row(d, "transactions", txid="tx101")["fee_sats"] = None
        golden.row(d, "transactions", txid="tx102")["block_hash"] = None

    s = severities(spark, golden.broken(change))
    assert all(r["severity"] in (PASS, BOUNDARY) for r in s.values())


def test_null_previous_txid_is_foreign(spark):
    r = CHECKS[19].rows(golden.ledger(spark, golden.broken(golden.MUTATIONS[17])).window(100, 102)).first()
    assert (r["internal_count"], r["foreign_count"]) == (1, 2)


def test_counts_are_capped_at_ten(spark):
    def change(d):
        for k in range(15):
            d["transactions"].append(dict(golden.row(d, "transactions", txid="tx101")) | {"txid": f"n{k}", "transaction_index": -k - 1})

    r = gate.validate(golden.ledger(spark, golden.broken(change)).window(100, 102))
    d = next(c["details"] for c in r["checks"] if c["id"] == "transaction_index_nonnegative")
    assert (d["violation_count"], d["violation_count_exact"], len(d["samples"])) == (10, 15, 10)


def test_double_spends(spark):
    """The unspent metric counts an output once for each spend; the summary counts it once."""
    data = golden.broken(lambda d: d["inputs"].append(dict(golden.row(d, "inputs", txid="tx102")) | {"input_index": 1, "previous_txid": "cb100"}))
    w = golden.ledger(spark, data).window(100, 102)
    a, b = CHECKS[32].rows(w).first(), summary.spent_share(w).first()
    assert (a["total_outputs"], a["unspent_in_window_count"]) == (8, 5) and (b["total_outputs"], b["spent_in_window"]) == (7, 2)


def test_empty_window(spark):
    w = golden.ledger(spark, golden.tables()).window(500, 501)
    s = {r["check_number"]: r["severity"] for r in gate.severities(w).collect()}
    assert s[1] == FAIL and all(v in (PASS, BOUNDARY) for n, v in s.items() if n != 1)
    assert CHECKS[19].rows(w).first()["foreign_pct"] == 0.0 and summary.internal_share(w).first()["internal_pct"] is None


def test_conservation(window):
    """Without double spends, what is spent and what is not are all outputs, and internal inputs are spent outputs."""
    u, s, i = CHECKS[32].rows(window).first(), summary.spent_share(window).first(), summary.internal_share(window).first()
    assert u["unspent_in_window_count"] + s["spent_in_window"] == s["total_outputs"] and i["internal_count"] == s["spent_in_window"]


def test_single_pass_counts_add_up(spark):
    data = golden.broken(golden.MUTATIONS[29])
    led = golden.ledger(spark, data)
    n = lambda a, b: {r["check_number"]: r["violations"] for r in gate.counts(led.window(a, b)).collect()}
    whole, left, right = n(100, 102), n(100, 100), n(101, 102)
    assert all(whole[c.number] == left[c.number] + right[c.number] for c in CHECKS if c.dataset)


def test_counts_are_the_rows_of_each_check(spark):
    """Counted together or alone, on keys that are null, repeated, unknown, and fees, values and flags that are null or differ."""

    def change(d):
        add = lambda table, key, **new: d[table].append(dict(golden.row(d, table, txid=key)) | new)
        for k in range(3):
            add("transactions", "tx101", fee_sats=k, block_hash=None if k else "other")
            add("transactions", "tx102", txid=None, transaction_index=k, is_coinbase=k == 1)
            add("inputs", "tx101", previous_output_value_sats=None if k == 2 else 5, is_coinbase=[True, None, False][k])
            add("inputs", "tx102", txid=None, input_index=k // 2)
            add("outputs", "tx102", output_index=None if k else 0, value_sats=None if k else 7)
            add("outputs", "tx100", txid="nowhere" if k else None, output_index=0)
            add("transactions", "tx100", txid=f"alone{k}", block_height=101, transaction_index=7)
        d["blocks"].append(dict(golden.row(d, "blocks", block_height=101)) | {"block_hash": "second"})
        d["blocks"].append(dict(golden.row(d, "blocks", block_height=102)) | {"block_hash": None})
        golden.row(d, "blocks", block_height=100)["block_height"] = 99

    for data in (golden.broken(change), golden.tables()):
        w = golden.ledger(spark, data).window(100, 102)
        found = {r["check_number"]: r["violations"] for r in gate.counts(w).collect()}
        assert found == {c.number: c.rows(w).count() for c in CHECKS if c.severity != BOUNDARY}
    assert "CartesianProduct" not in gate.counts(w)._jdf.queryExecution().toString()


def test_reports_guard_loads(tmp_path):
    with pytest.raises(RuntimeError):
        gate.load_report(str(tmp_path), 1, 2)
    gate.write_report({"requested_start_height": 1, "requested_end_height": 2, "overall_status": FAIL}, gate.report_path(str(tmp_path), 1, 2))
    with pytest.raises(RuntimeError):
        gate.load_report(str(tmp_path), 1, 2)
