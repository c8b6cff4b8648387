"""Three blocks of two transactions each, all right; a copy of it is broken one fact at a time."""

from __future__ import annotations

import copy

from basalt.operators.ledger import Ledger
from basalt.sources.schemas import DATASETS

BIG = 4294967295
COINBASE = 625_000_000


def tables() -> dict[str, list[dict]]:
    b, t, i, o = [], [], [], []
    for h in (100, 101, 102):
        cb, tx = f"cb{h}", f"tx{h}"
        b.append(dict(block_height=h, block_hash=f"hash{h}", previous_block_hash=f"hash{h - 1}", timestamp=1700000000 + h, transaction_count=2, size_bytes=450, weight_units=1700))
        t.append(dict(block_height=h, block_hash=f"hash{h}", txid=cb, transaction_index=0, size_bytes=200, weight_units=800, vsize=200, fee_sats=0, is_coinbase=True))
        fee = 50 * (h - 98)
        t.append(dict(block_height=h, block_hash=f"hash{h}", txid=tx, transaction_index=1, size_bytes=250, weight_units=900, vsize=225, fee_sats=fee, is_coinbase=False))
        i.append(dict(block_height=h, txid=cb, input_index=0, previous_txid="0" * 64, previous_vout_index=BIG, previous_output_value_sats=None, is_coinbase=True))
        value = 100_000 if h == 100 else COINBASE
        i.append(dict(block_height=h, txid=tx, input_index=0, previous_txid="foreign" if h == 100 else f"cb{h - 1}", previous_vout_index=0, previous_output_value_sats=value, is_coinbase=False))
        o.append(dict(block_height=h, txid=cb, output_index=0, value_sats=COINBASE, address=f"miner{h}", script_type="v0_p2wpkh"))
        o.append(dict(block_height=h, txid=tx, output_index=0, value_sats=value - fee, address=f"payee{h}", script_type="p2sh"))
    o.append(dict(block_height=102, txid="tx102", output_index=1, value_sats=0, address=None, script_type="op_return"))
    return {"blocks": b, "transactions": t, "inputs": i, "outputs": o}


def ledger(spark, data: dict[str, list[dict]]) -> Ledger:
    frames = []
    for name, schema in DATASETS.items():
        rows = [tuple(r.get(f) for f in schema.fieldNames()) for r in data[name]]
        frames.append(spark.createDataFrame(rows, schema))
    return Ledger(*frames)


def broken(change) -> dict[str, list[dict]]:
    data = copy.deepcopy(tables())
    change(data)
    return data


def row(data, table, **where):
    return next(r for r in data[table] if all(r[k] == v for k, v in where.items()))


def _set(table, new, **where):
    return lambda d: row(d, table, **where).update(new)


def _twice(table, **where):
    return lambda d: d[table].append(dict(row(d, table, **where)))


def _drop(table, **where):
    return lambda d: d[table].remove(row(d, table, **where))


def _add(table, of, **new):
    return lambda d: d[table].append(dict(row(d, table, **of)) | new)


#: Check number to the change that breaks it.
MUTATIONS = {
    1: _drop("blocks", block_height=101),
    2: _add("blocks", {"block_height": 100}, block_hash="other"),
    3: _twice("blocks", block_height=100),
    4: _set("blocks", {"transaction_count": 99}, block_height=101),
    5: _set("transactions", {"is_coinbase": True}, txid="tx101"),
    6: _set("transactions", {"block_hash": "wrong"}, txid="tx101"),
    7: _set("blocks", {"previous_block_hash": "wrong"}, block_height=102),
    9: _twice("transactions", txid="tx101"),
    10: _drop("blocks", block_height=101),
    11: _set("transactions", {"transaction_index": -1}, txid="tx101"),
    12: _set("transactions", {"transaction_index": 0}, txid="tx101"),
    13: _drop("inputs", txid="tx101"),
    14: _set("transactions", {"transaction_index": 5}, txid="cb101"),
    15: _set("inputs", {"is_coinbase": True}, txid="tx101"),
    16: _twice("inputs", txid="tx101"),
    17: _set("inputs", {"previous_txid": None}, txid="tx101"),
    18: _set("inputs", {"previous_output_value_sats": 1}, txid="cb101"),
    19: _set("inputs", {"previous_output_value_sats": -1}, txid="tx101"),
    21: _set("inputs", {"previous_vout_index": 5}, txid="tx101"),
    22: _twice("outputs", txid="tx101"),
    23: _set("outputs", {"value_sats": -1}, txid="tx101"),
    25: _add("outputs", {"txid": "tx101"}, txid="orphan"),
    26: _set("transactions", {"fee_sats": 99999}, txid="tx101"),
    27: _set("transactions", {"fee_sats": -1}, txid="tx101"),
    28: _set("transactions", {"fee_sats": 7}, txid="cb101"),
    29: _set("transactions", {"size_bytes": 0}, txid="tx101"),
    30: _set("transactions", {"weight_units": 0}, txid="tx101"),
    31: _set("transactions", {"vsize": 999}, txid="tx101"),
    32: _set("transactions", {"size_bytes": 100}, txid="tx101"),
}
