"""The catalogue's queries in SQL, written on their own, for DuckDB to check results by."""

from __future__ import annotations

LO, HI = 0, 79

CLEAN = """
o AS (SELECT o_orderkey AS k, o_custkey AS cust, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS h,
        row_number() OVER (PARTITION BY year(o_orderdate), month(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
        lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior FROM orders),
ln AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) - 1 AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS val,
        CASE min(l_returnflag) WHEN 'N' THEN NULL ELSE 'addr' || CAST(min(l_partkey) AS VARCHAR) END AS adr,
        CASE min(l_returnflag) WHEN 'N' THEN 'op_return' WHEN 'A' THEN 'v0_p2wpkh' ELSE 'p2sh' END AS scr FROM lineitem GROUP BY l_orderkey, l_linenumber),
outputs0 AS (SELECT o.h AS block_height, CAST(o.k AS VARCHAR) AS txid, ln.n AS output_index, ln.val AS value_sats, ln.adr AS address, ln.scr AS script_type,
        md5(CAST(o.k AS VARCHAR) || ':' || CAST(ln.n AS VARCHAR)) AS scriptpubkey FROM o JOIN ln ON ln.k = o.k),
in_rows AS (
  SELECT h, k, CAST(0 AS BIGINT) AS n, repeat('0', 64) AS ptx, CAST(4294967295 AS BIGINT) AS pv, CAST(NULL AS BIGINT) AS val, CAST(NULL AS VARCHAR) AS adr, CAST(NULL AS VARCHAR) AS scr, TRUE AS cb FROM o WHERE idx = 0
  UNION ALL SELECT h, k, 0, 'ext' || CAST(cust AS VARCHAR), 0, 10000000, NULL, NULL, FALSE FROM o WHERE idx <> 0 AND prior IS NULL
  UNION ALL SELECT o.h, o.k, row_number() OVER (PARTITION BY o.k ORDER BY ln.n) - 1, CAST(o.prior AS VARCHAR), ln.n, ln.val, ln.adr, ln.scr, FALSE FROM o JOIN ln ON ln.k = o.prior AND ln.n < 3 WHERE o.idx <> 0),
inputs0 AS (SELECT h AS block_height, CAST(k AS VARCHAR) AS txid, n AS input_index, ptx AS previous_txid, pv AS previous_vout_index, val AS previous_output_value_sats, adr AS previous_output_address,
        scr AS previous_output_script_type, md5('s' || CAST(k AS VARCHAR)) AS scriptsig, 4294967295 - n AS "sequence", cb AS is_coinbase FROM in_rows),
tx0 AS (SELECT o.h AS block_height, md5('b' || CAST(o.h AS VARCHAR)) AS block_hash, CAST(o.k AS VARCHAR) AS txid, o.idx AS transaction_index, CAST(2 AS BIGINT) AS version, CAST(0 AS BIGINT) AS locktime,
        200 + o.k % 800 AS size_bytes, 4 * (200 + o.k % 800) - 3 * (o.k % 150) AS weight_units,
        CAST(ceil((4 * (200 + o.k % 800) - 3 * (o.k % 150)) / 4) AS BIGINT) + CASE WHEN o.k % 4999 = 7 THEN 1 ELSE 0 END AS vsize,
        CAST(CASE WHEN o.idx = 0 THEN 0 ELSE coalesce(i.s, 0) - coalesce(u.s, 0) + CASE WHEN o.k % 997 = 3 THEN 1 ELSE 0 END END AS BIGINT) AS fee_sats, o.idx = 0 AS is_coinbase
  FROM o LEFT JOIN (SELECT k, sum(val) AS s FROM in_rows GROUP BY k) i ON i.k = o.k LEFT JOIN (SELECT k, sum(val) AS s FROM ln GROUP BY k) u ON u.k = o.k),
blocks0 AS (SELECT block_height, md5('b' || CAST(block_height AS VARCHAR)) AS block_hash,
        CASE WHEN block_height % 31 = 30 THEN md5('broken' || CAST(block_height AS VARCHAR)) ELSE md5('b' || CAST(block_height - 1 AS VARCHAR)) END AS previous_block_hash,
        788918400 + 2629800 * block_height AS "timestamp", count(*) + CASE WHEN block_height % 37 = 36 THEN 1 ELSE 0 END AS transaction_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
        CAST(sum(weight_units) AS BIGINT) AS weight_units, CAST(block_height + 1 AS DOUBLE) AS difficulty, md5('m' || CAST(block_height AS VARCHAR)) AS merkle_root, block_height * 7919 AS nonce, block_height + 386000000 AS bits
  FROM tx0 GROUP BY block_height)"""

_PLAIN = """,
blocks AS (SELECT * FROM blocks0), transactions AS (SELECT * FROM tx0), inputs AS (SELECT * FROM inputs0), outputs AS (SELECT * FROM outputs0)"""


def _m(a: int, r: int) -> str:
    return f"coalesce(try_cast(txid AS BIGINT) % {a} = {r}, FALSE)"


_BROKEN = f""",
blocks AS (SELECT * FROM blocks0 WHERE block_height <> 40 UNION ALL SELECT * FROM blocks0 WHERE block_height = 44),
transactions AS (SELECT * REPLACE (is_coinbase OR {_m(2503, 11)} AS is_coinbase, CASE WHEN {_m(1999, 5)} THEN 'bad' ELSE block_hash END AS block_hash, CASE WHEN {_m(2801, 4)} THEN -1 ELSE transaction_index END AS transaction_index,
    CASE WHEN {_m(2513, 17)} THEN 0 ELSE size_bytes END AS size_bytes, CASE WHEN {_m(2617, 18)} THEN 0 ELSE weight_units END AS weight_units)
  FROM (SELECT * FROM tx0 UNION ALL SELECT * FROM tx0 WHERE {_m(3001, 9)})),
inputs AS (SELECT * REPLACE (is_coinbase OR {_m(2503, 11)} OR {_m(2203, 6)} AS is_coinbase, CASE WHEN {_m(1801, 10)} THEN NULL ELSE previous_txid END AS previous_txid,
    CASE WHEN {_m(1901, 12)} THEN -5 ELSE previous_output_value_sats END AS previous_output_value_sats, previous_vout_index + CASE WHEN {_m(1301, 13)} THEN 50 ELSE 0 END AS previous_vout_index)
  FROM (SELECT * FROM inputs0 UNION ALL SELECT * FROM inputs0 WHERE {_m(2707, 8)})),
outputs AS (SELECT * REPLACE (CASE WHEN {_m(2311, 15)} AND output_index < 3 THEN -1 ELSE value_sats END AS value_sats)
  FROM (SELECT * FROM outputs0 UNION ALL SELECT * FROM outputs0 WHERE {_m(2909, 14)})
  UNION ALL SELECT * REPLACE ('orphan' || txid AS txid) FROM outputs0 WHERE {_m(2411, 16)})"""


def clean(sql: str) -> str:
    return f"WITH {CLEAN.strip()}{_PLAIN}{sql if sql.startswith(',') else ' ' + sql}"


def dirty(sql: str) -> str:
    return f"WITH {CLEAN.strip()}{_BROKEN}{sql if sql.startswith(',') else ' ' + sql}"


_IN = f"block_height BETWEEN {LO} AND {HI}"


def _dup(table: str, keys: str) -> str:
    return f"SELECT {keys}, count(*) AS occurrences FROM {table} WHERE {_IN} GROUP BY {keys} HAVING count(*) > 1"


_PCT = "coalesce(round(100.0 * {0} / nullif({1}, 0), 2), 0)"
_INTERNAL = f"i.previous_txid IN (SELECT txid FROM transactions WHERE {_IN})"
_SUMS = f"""(SELECT txid, sum(previous_output_value_sats) AS s, count(*) FILTER (WHERE previous_output_value_sats IS NULL) AS unknown FROM inputs WHERE {_IN} AND NOT is_coinbase GROUP BY txid)"""

GATE = {
    "g01": f"SELECT e.h AS missing_height FROM range({LO}, {HI + 1}) e(h) WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.block_height = e.h)",
    "g02": _dup("blocks", "block_height"),
    "g03": _dup("blocks", "block_hash"),
    "g04": f"SELECT b.block_height, b.transaction_count AS reported, count(t.txid) AS actual FROM blocks b LEFT JOIN transactions t ON t.block_height = b.block_height WHERE b.{_IN} GROUP BY 1, 2 HAVING count(t.txid) <> b.transaction_count",
    "g05": f"SELECT block_height, CAST(sum(CASE WHEN is_coinbase THEN 1 ELSE 0 END) AS BIGINT) AS coinbase_count FROM transactions WHERE {_IN} GROUP BY 1 HAVING coinbase_count <> 1",
    "g06": f"SELECT t.txid, t.block_height, t.block_hash AS tx_block_hash, b.block_hash AS blocks_table_hash FROM transactions t, blocks b WHERE t.{_IN} AND b.block_height = t.block_height AND b.block_hash <> t.block_hash",
    "g07": f"SELECT b.block_height, b.previous_block_hash, p.block_hash AS expected_prior_hash FROM blocks b LEFT JOIN blocks p ON p.block_height + 1 = b.block_height WHERE b.block_height > {LO} AND b.block_height <= {HI} AND (p.block_hash IS NULL OR p.block_hash <> b.previous_block_hash)",
    "g08": f"SELECT block_height, previous_block_hash FROM blocks WHERE block_height = {LO} ORDER BY 2 LIMIT 1",
    "g09": _dup("transactions", "txid"),
    "g10": f"SELECT t.txid, t.block_height FROM transactions t WHERE t.{_IN} AND t.block_height NOT IN (SELECT block_height FROM blocks)",
    "g11": f"SELECT txid, block_height, transaction_index FROM transactions WHERE {_IN} AND transaction_index < 0",
    "g12": _dup("transactions", "block_height, transaction_index"),
    "g13": f"SELECT DISTINCT txid, 'input' AS missing FROM transactions WHERE {_IN} AND txid NOT IN (SELECT txid FROM inputs WHERE {_IN}) UNION ALL SELECT DISTINCT txid, 'output' FROM transactions WHERE {_IN} AND txid NOT IN (SELECT txid FROM outputs WHERE {_IN})",
    "g14": f"SELECT block_height, txid, transaction_index FROM transactions WHERE {_IN} AND is_coinbase AND transaction_index <> 0",
    "g15": f"SELECT DISTINCT t.txid FROM transactions t JOIN inputs i USING (txid) WHERE t.{_IN} AND i.{_IN} AND NOT t.is_coinbase AND i.is_coinbase",
    "g16": _dup("inputs", "txid, input_index"),
    "g17": f"SELECT txid, input_index FROM inputs WHERE {_IN} AND NOT is_coinbase AND (previous_txid IS NULL OR previous_vout_index IS NULL)",
    "g18": f"SELECT txid, input_index, previous_output_value_sats FROM inputs WHERE {_IN} AND is_coinbase AND previous_output_value_sats IS NOT NULL",
    "g19": f"SELECT txid, input_index, previous_output_value_sats FROM inputs WHERE {_IN} AND previous_output_value_sats < 0",
    "g20": f"SELECT count(*) AS total_ordinary_inputs, count(*) FILTER (WHERE x) AS internal_count, count(*) FILTER (WHERE NOT x) AS foreign_count, {_PCT.format('count(*) FILTER (WHERE NOT x)', 'count(*)')} AS foreign_pct FROM (SELECT coalesce({_INTERNAL}, FALSE) AS x FROM inputs i WHERE {_IN} AND NOT is_coinbase)",
    "g21": f"SELECT i.txid, i.input_index, i.previous_txid, i.previous_vout_index, count(u.output_index) AS matching_outputs FROM inputs i LEFT JOIN outputs u ON u.txid = i.previous_txid AND u.output_index = i.previous_vout_index AND u.{_IN} WHERE i.{_IN} AND NOT i.is_coinbase AND {_INTERNAL} GROUP BY ALL HAVING count(u.output_index) <> 1",
    "g22": _dup("outputs", "txid, output_index"),
    "g23": f"SELECT txid, output_index, value_sats FROM outputs WHERE {_IN} AND value_sats < 0",
    "g24": f"SELECT count(*) AS total_outputs, count(*) - count(address) AS no_address_count, {_PCT.format('(count(*) - count(address))', 'count(*)')} AS no_address_pct FROM outputs WHERE {_IN}",
    "g25": f"SELECT txid, output_index FROM outputs WHERE {_IN} AND txid NOT IN (SELECT txid FROM transactions WHERE {_IN})",
    "g26": f"SELECT t.txid, t.fee_sats AS reported_fee, CAST(i.s - u.s AS BIGINT) AS derived_fee FROM transactions t JOIN {_SUMS} i USING (txid) JOIN (SELECT txid, sum(value_sats) AS s FROM outputs WHERE {_IN} GROUP BY txid) u USING (txid) WHERE t.{_IN} AND NOT t.is_coinbase AND i.unknown = 0 AND i.s - u.s <> t.fee_sats",
    "g27": f"SELECT txid, fee_sats FROM transactions WHERE {_IN} AND NOT is_coinbase AND fee_sats < 0",
    "g28": f"SELECT txid, fee_sats FROM transactions WHERE {_IN} AND is_coinbase AND fee_sats <> 0",
    "g29": f"SELECT txid, size_bytes FROM transactions WHERE {_IN} AND size_bytes <= 0",
    "g30": f"SELECT txid, weight_units FROM transactions WHERE {_IN} AND weight_units <= 0",
    "g31": f"SELECT txid, weight_units, vsize FROM transactions WHERE {_IN} AND vsize <> CAST(ceil(weight_units / 4.0) AS BIGINT)",
    "g32": f"SELECT txid, size_bytes, weight_units FROM transactions WHERE {_IN} AND weight_units > 4 * size_bytes",
    "g33": f"SELECT count(*) AS total_outputs, count(*) FILTER (WHERE i.txid IS NULL) AS unspent_in_window_count, {_PCT.format('count(*) FILTER (WHERE i.txid IS NULL)', 'count(*)')} AS unspent_in_window_pct FROM outputs u LEFT JOIN inputs i ON i.previous_txid = u.txid AND i.previous_vout_index = u.output_index AND i.{_IN} AND NOT i.is_coinbase WHERE u.{_IN}",
}

SIZES = f"SELECT {', '.join(f'min({c}) AS min_{n}, round(avg({c}), 1) AS avg_{n}, max({c}) AS max_{n}' for n, c in (('size', 'size_bytes'), ('weight', 'weight_units'), ('vsize', 'vsize')))} FROM transactions WHERE {_IN}"
FEE_COVERAGE = f"SELECT count(*) AS total_ordinary_transactions, count(*) FILTER (WHERE i.unknown = 0) AS checkable_transactions FROM transactions t JOIN {_SUMS} i USING (txid) WHERE t.{_IN} AND NOT t.is_coinbase"


def severities(checks) -> str:
    parts = []
    for c in checks:
        key = f"g{c.number:02d}"
        n = "SELECT CAST(0 AS BIGINT) AS n" if c.severity == "EXPECTED_BOUNDARY" else f"SELECT count(*) AS n FROM ({GATE[key]})"
        name = "'EXPECTED_BOUNDARY'" if c.severity == "EXPECTED_BOUNDARY" else f"CASE WHEN n > 0 THEN '{c.severity}' ELSE 'PASS' END"
        parts.append(f"SELECT {c.number} AS check_number, '{c.id}' AS check_id, '{c.category}' AS category, {name} AS severity, n AS violations FROM ({n})")
    return " UNION ALL ".join(parts)


_SPENT = f"(u.txid, u.output_index) IN (SELECT (previous_txid, previous_vout_index) FROM inputs WHERE {_IN} AND NOT is_coinbase AND previous_txid IS NOT NULL)"
SUMMARY = {
    "m01_blocks_and_transactions": f"SELECT b.block_height, b.block_hash, count(t.txid) AS tx_count FROM blocks b LEFT JOIN transactions t USING (block_height) WHERE b.{_IN} GROUP BY 1, 2",
    "m02_fees_by_block": f"SELECT block_height, CAST(sum(fee_sats) AS BIGINT) AS total_fees_sats, round(avg(CAST(fee_sats AS DOUBLE) / vsize), 3) AS avg_fee_rate_sats_per_vbyte FROM transactions WHERE {_IN} AND NOT is_coinbase GROUP BY 1",
    "m03_block_weight": f"SELECT round(avg(weight_units), 1) AS avg_weight_units, max(weight_units) AS max_weight_units FROM blocks WHERE {_IN}",
    "m04_transaction_sizes": f"SELECT round(avg(size_bytes), 1) AS avg_size_bytes, round(avg(weight_units), 1) AS avg_weight_units, round(avg(vsize), 1) AS avg_vsize FROM transactions WHERE {_IN}",
    "m05_input_output_totals": f"SELECT (SELECT count(*) FROM inputs WHERE {_IN}) AS input_count, (SELECT count(*) FROM outputs WHERE {_IN}) AS output_count",
    "m06_internal_share": f"SELECT count(*) AS total_ordinary_inputs, count(*) FILTER (WHERE x) AS internal_count, round(100.0 * count(*) FILTER (WHERE x) / count(*), 2) AS internal_pct FROM (SELECT coalesce({_INTERNAL}, FALSE) AS x FROM inputs i WHERE {_IN} AND NOT is_coinbase)",
    "m07_spent_share": f"SELECT count(*) AS total_outputs, count(*) FILTER (WHERE x) AS spent_in_window, round(100.0 * count(*) FILTER (WHERE x) / count(*), 2) AS spent_in_window_pct FROM (SELECT {_SPENT} AS x FROM outputs u WHERE {_IN})",
    "m08_script_types": f"SELECT script_type, count(*) AS output_count FROM outputs WHERE {_IN} GROUP BY 1",
    "m09_addressless": f"SELECT count(*) AS total_outputs, count(*) FILTER (WHERE address IS NULL) AS no_address_count, round(100.0 * count(*) FILTER (WHERE address IS NULL) / count(*), 2) AS no_address_pct FROM outputs WHERE {_IN}",
    "m10_heaviest": f"SELECT txid, block_height, weight_units, size_bytes, vsize FROM transactions WHERE {_IN} ORDER BY weight_units DESC NULLS LAST, txid LIMIT 10",
    "m11_highest_fee_rates": f"SELECT txid, block_height, fee_sats, vsize, round(CAST(fee_sats AS DOUBLE) / vsize, 3) AS fee_rate_sats_per_vbyte FROM transactions WHERE {_IN} AND NOT is_coinbase ORDER BY fee_rate_sats_per_vbyte DESC NULLS LAST, txid LIMIT 10",
}

_VIN = "(SELECT txid, count(*) AS n FROM inputs GROUP BY txid)"
_ORD = "(SELECT t.* FROM transactions t WHERE EXISTS (SELECT 1 FROM inputs i WHERE i.txid = t.txid AND i.input_index = 0 AND NOT i.is_coinbase))"
_SAMPLE = f"(SELECT t.txid FROM {_ORD} t JOIN {_VIN} v USING (txid) WHERE v.n > 1 ORDER BY t.block_height, t.txid LIMIT 1)"
EXPLORE = {
    "e01_block_summary": "SELECT block_height AS height, block_hash, transaction_count AS tx_count, size_bytes AS size, weight_units AS weight, make_timestamp(\"timestamp\" * 1000000) AS block_time FROM blocks",
    "e02_completeness": "SELECT b.block_height AS height, b.transaction_count AS reported_tx_count, count(t.txid) AS fetched_tx_count FROM blocks b LEFT JOIN transactions t ON t.block_hash = b.block_hash GROUP BY 1, 2",
    "e03_coinbase": f"SELECT t.txid, t.fee_sats AS fee, v.n AS num_inputs, count(u.txid) AS num_outputs, max(u.value_sats) FILTER (WHERE u.output_index = f.first) AS first_output_value_sats FROM transactions t JOIN inputs i ON i.txid = t.txid AND i.input_index = 0 AND i.is_coinbase JOIN {_VIN} v ON v.txid = t.txid LEFT JOIN outputs u ON u.txid = t.txid LEFT JOIN (SELECT txid, min(output_index) AS first FROM outputs GROUP BY txid) f ON f.txid = t.txid GROUP BY 1, 2, 3",
    "e04_fee_distribution": f"SELECT count(*) AS num_txs, min(fee_sats) AS min_fee_sats, round(avg(fee_sats), 1) AS avg_fee_sats, max(fee_sats) AS max_fee_sats, CAST(sum(fee_sats) AS BIGINT) AS total_fees_sats FROM {_ORD}",
    "e05_sample": f"SELECT txid FROM {_SAMPLE}",
    "e06_sample_inputs": f"SELECT input_index + 1 AS idx, previous_output_value_sats AS value_sats, previous_output_address AS address FROM inputs WHERE txid IN {_SAMPLE}",
    "e07_sample_outputs": f"SELECT row_number() OVER (ORDER BY output_index) AS idx, value_sats, address FROM outputs WHERE txid IN {_SAMPLE}",
    "e08_chain": "SELECT block_height AS height, block_hash, previous_block_hash AS previousblockhash, lag(block_hash) OVER (ORDER BY block_height) AS prior_block_hash_in_window, previous_block_hash = lag(block_hash) OVER (ORDER BY block_height) AS linked_to_prior FROM blocks",
    "e09_by_block": f"SELECT t.block_height AS height, count(*) AS tx_count, count(*) FILTER (WHERE q.txid IS NOT NULL) AS ordinary_tx_count, CAST(sum(t.fee_sats) FILTER (WHERE q.txid IS NOT NULL) AS BIGINT) AS total_fees_sats, round(avg(t.fee_sats) FILTER (WHERE q.txid IS NOT NULL), 1) AS avg_fee_sats FROM transactions t LEFT JOIN {_ORD} q ON q.txid = t.txid GROUP BY 1",
    "e10_block_sizes": "SELECT round(avg(weight_units), 1) AS avg_weight_units, max(weight_units) AS max_weight_units, round(avg(size_bytes), 1) AS avg_size_bytes, max(size_bytes) AS max_size_bytes FROM blocks",
    "e11_transaction_sizes": "SELECT round(avg(size_bytes), 1) AS avg_size_bytes, round(avg(weight_units), 1) AS avg_weight_units, round(avg(ceil(weight_units / 4.0)), 1) AS avg_vsize FROM transactions",
    "e12_in_out_counts": f"SELECT min(v.n) AS min_inputs, round(avg(v.n), 2) AS avg_inputs, max(v.n) AS max_inputs, min(coalesce(u.n, 0)) AS min_outputs, round(avg(coalesce(u.n, 0)), 2) AS avg_outputs, max(coalesce(u.n, 0)) AS max_outputs FROM {_ORD} t JOIN {_VIN} v USING (txid) LEFT JOIN (SELECT txid, count(*) AS n FROM outputs GROUP BY txid) u USING (txid)",
    "e13_foreign_inputs": "SELECT count(*) AS ordinary_input_count, count(*) FILTER (WHERE NOT coalesce(previous_txid IN (SELECT txid FROM transactions), FALSE)) AS foreign_input_count FROM inputs WHERE NOT is_coinbase",
    "e14_spent_outputs": f"SELECT count(*) AS outputs_created_in_window, count(*) FILTER (WHERE x) AS outputs_also_spent_in_window FROM (SELECT (txid, rn) IN (SELECT (previous_txid, previous_vout_index) FROM inputs WHERE NOT is_coinbase) AS x FROM (SELECT txid, row_number() OVER (PARTITION BY txid ORDER BY output_index) - 1 AS rn FROM outputs))",
}
