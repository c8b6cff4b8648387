import json
import os
import urllib.error

import pytest

from basalt import cli
from basalt.operators import flatten
from basalt.plans import explore, warehouse
from basalt.sources import raw, store
from basalt.sources.schemas import DATASETS, KEYS
from basalt.streaming import incremental

from . import golden


class Chain:
    """A client over made-up blocks; hash and content depend on the height alone."""

    address = "made-up"

    def __init__(self, sizes, bad=()):
        self.sizes, self.bad, self.calls = sizes, set(bad), []

    def tip_height(self):
        return max(self.sizes)

    def block_hash(self, h):
        self.calls.append(h)
        if h in self.bad or h not in self.sizes:
            raise RuntimeError(f"no block {h}")
        return f"hash{h}"

    def block(self, x):
        h = int(x[4:])
        return dict(id=x, height=h, previousblockhash=f"hash{h - 1}", timestamp=1700000000 + h, tx_count=self.sizes[h], size=1000, weight=4000, difficulty=1.5, merkle_root="m", nonce=BIG, bits=BIG)

    def block_txs(self, x):
        h = int(x[4:])
        out = [tx(h, k) for k in range(self.sizes[h])]
        return out, 1


BIG = 4294967295


def tx(h, k):
    cb = k == 0
    vin = dict(txid="0" * 64 if cb else f"t{h - 1}.0", vout=BIG if cb else 0, prevout=None if cb else dict(value=1000, scriptpubkey_address="a", scriptpubkey_type="p2sh"), scriptsig="s", sequence=BIG, is_coinbase=cb)
    vout = [dict(value=900, scriptpubkey_address="b", scriptpubkey_type="p2sh", scriptpubkey="k"), dict(value=0, scriptpubkey_address=None, scriptpubkey_type="op_return", scriptpubkey="k")]
    return dict(txid=f"t{h}.{k}", version=2, locktime=0, size=250, weight=401 + k, fee=0 if cb else 100, vin=[vin] if k != 2 else [], vout=vout, status=dict(confirmed=True, block_height=h, block_hash=f"hash{h}"))


def test_pages():
    items = list(range(60))
    assert raw.pages(lambda o: items[o : o + 25]) == (items, 3)
    assert raw.pages(lambda o: items[:50][o : o + 25]) == (items[:50], 3)  # an empty last page counts
    assert raw.pages(lambda o: []) == ([], 1)


def test_client_tries_again_but_not_for_404():
    waits, tries = [], []

    def fails(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("down")
        return b"5"

    assert raw.RestClient("http://x/", fails, waits.append).tip_height() == 5 and waits == [0.5, 1.0]

    def missing(url):
        tries.append(url)
        raise urllib.error.HTTPError(url, 404, "", {}, None)

    tries.clear()
    c = raw.RestClient("http://x", missing, waits.append)
    assert c.block_txs("h") == ([], 1) and len(tries) == 1
    with pytest.raises(raw.NotFound):
        c.block("h")

    def down(url):
        raise OSError

    with pytest.raises(RuntimeError):
        raw.RestClient("http://x", down, waits.append).tip_height()


@pytest.mark.parametrize("args, want", [((5, 9), (5, 9)), ((5, None, 3), (5, 7)), ((None, None, 3, 2, 100), (96, 98)), ((None, None, None, None, 1000), (891, 900))])
def test_ranges(args, want):
    assert raw.resolve_range(*args) == want


@pytest.mark.parametrize("args", [(9, 5), (5, 9, 3), (None, 9), (None, None, 3, 2, None), (5, None, 0)])
def test_bad_ranges(args):
    with pytest.raises(ValueError):
        raw.resolve_range(*args)


def test_publishing_is_whole_or_nothing(tmp_path, monkeypatch):
    root = str(tmp_path)
    c = Chain({7: 2})
    assert raw.ingest_block(c, 7, root) and not raw.ingest_block(c, 7, root)
    assert raw.ingest_block(c, 7, root, force=True)  # over what is there
    where = raw.block_dir(root, 7)
    assert os.path.basename(where) == "0000007" and raw.is_complete(where) and sorted(os.listdir(root)) == ["0000007"]
    meta = json.load(open(f"{where}/_meta.json"))
    assert len(meta) == 7 and meta["tx_count_fetched"] == meta["tx_count_reported"] == 2
    before = open(f"{where}/txs.jsonl").read()
    monkeypatch.setattr(raw.json, "dumps", lambda *_: (_ for _ in ()).throw(RuntimeError("disk")))
    with pytest.raises(RuntimeError):
        raw.publish_block(root, 7, {}, [{}], {})
    monkeypatch.undo()
    assert open(f"{where}/txs.jsonl").read() == before and sorted(os.listdir(root)) == ["0000007"]


def test_completeness(tmp_path):
    where = raw.publish_block(str(tmp_path), 3, {}, [], dict(tx_count_fetched=1, tx_count_reported=2))
    assert not raw.is_complete(where)
    for meta, want in ((dict(tx_count_fetched=1), True), (dict(tx_count_reported=1), False), (dict(tx_count_fetched=2, tx_count_reported=2), True)):
        raw.publish_block(str(tmp_path), 3, {}, [], meta)
        assert raw.is_complete(where) == want
    open(f"{where}/_meta.json", "w").write("{")
    assert not raw.is_complete(where) and not raw.is_complete(str(tmp_path / "none"))


def test_one_height_fails_alone(tmp_path):
    waits = []
    r = raw.ingest_range(Chain({1: 1, 2: 1, 3: 1}, bad=[2]), 1, 3, str(tmp_path), sleep=waits.append)
    assert r.fetched == [1, 3] and [h for h, _ in r.failed] == [2] and not r.complete and len(waits) == 1
    assert raw.ingest_range(Chain({1: 1}), 1, 1, str(tmp_path), sleep=waits.append).skipped == [1]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    raw.ingest_range(Chain({5: 3, 6: 30, 7: 2}), 5, 7, root, sleep=lambda s: None)
    with open(f"{root}/0000006/txs.jsonl") as f:
        lines = f.read().split("\n")
    with open(f"{root}/0000006/txs.jsonl", "w") as f:
        f.write("\n\n".join(lines) + "\n \n")  # blank lines count for nothing
    bad = tx(8, 0)
    del bad["version"]
    raw.publish_block(root, 8, Chain({8: 1}).block("hash8"), [bad], {"block_height": 8})
    out = str(tmp_path_factory.mktemp("parquet"))
    return root, out, store.build(spark, root, out, list(range(5, 10)))


def test_build(spark, built):
    root, out, result = built
    assert result == {"skipped": [], "missing_raw": [9], "failed": [8], "created": [5, 6, 7]}
    led = store.read_ledger(spark, out)
    for name in DATASETS:
        df = getattr(led, name)
        assert df.columns == DATASETS[name].fieldNames() and [f.dataType for f in df.schema] == [f.dataType for f in DATASETS[name]]
    t = led.transactions.where("block_height = 6").orderBy("transaction_index").collect()
    assert [r["txid"] for r in t] == [f"t6.{k}" for k in range(30)] and [r["transaction_index"] for r in t] == list(range(30))
    assert [r["vsize"] for r in t[:4]] == [101, 101, 101, 101] and [r["is_coinbase"] for r in t[:3]] == [True, False, False]
    i = {(r["txid"], r["input_index"]): r for r in led.inputs.collect()}
    assert ("t6.2", 0) not in i and i["t6.0", 0]["previous_vout_index"] == BIG and i["t6.0", 0]["previous_output_value_sats"] is None and i["t6.1", 0]["previous_output_value_sats"] == 1000
    assert led.outputs.where("address is null").count() == 35
    assert store.row_counts(spark, out)["outputs"] == {5: 6, 6: 60, 7: 4}
    assert store.complete_heights(spark, out) == {5, 6, 7}
    plan = led.transactions.where("block_height = 6")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(block_height" in plan


def test_rebuilds(spark, built):
    root, out, _ = built
    before = store.row_counts(spark, out)
    assert store.build(spark, root, out, [5, 6])["skipped"] == [5, 6]
    assert store.build(spark, root, out, [6], force=True)["created"] == [6]  # other heights stay
    assert store.row_counts(spark, out) == before
    store.register_views(spark, out)
    assert spark.sql("select count(*) from transactions").first()[0] == 35


def test_missing_flags_and_empty_inputs(spark):
    rows = [dict(block_height=1, block_hash="h", transaction_index=0, **(tx(1, 1) | {"vin": v})) for v in ([], [dict(tx(1, 1)["vin"][0], is_coinbase=None)])]
    from pyspark.sql import types as T

    from basalt.sources.schemas import RAW_TX

    schema = T.StructType([T.StructField("block_height", T.LongType()), T.StructField("block_hash", T.StringType()), T.StructField("transaction_index", T.LongType()), *RAW_TX.fields])
    df = spark.createDataFrame(rows, schema)
    assert [r["is_coinbase"] for r in flatten.transactions(df).collect()] == [False, False]
    assert [r["is_coinbase"] for r in flatten.inputs(df).collect()] == [False]


def test_exploration_of_raw_files(spark, built):
    root = built[0]
    r = explore.Raw(raw.read_blocks(spark, root).where("height < 8"), raw.read_transactions(spark, root).where("status.block_height < 8"))
    q = {n: f(r).collect() for n, f in explore.EXPLORE.items()}
    assert [x["fetched_tx_count"] for x in q["e02_completeness"]] == [3, 30, 2]
    assert [x["linked_to_prior"] for x in q["e08_chain"]] == [None, True, True]
    assert q["e05_sample"] == [] and q["e06_sample_inputs"] == []
    assert len(q["e03_coinbase"]) == 3 and q["e14_spent_outputs"][0].asDict() == {"outputs_created_in_window": 70, "outputs_also_spent_in_window": 2}
    assert q["e13_foreign_inputs"][0].asDict() == {"ordinary_input_count": 30, "foreign_input_count": 1}
    explore.show(r)


def test_data_source(spark):
    reader = raw.RestReader({"address": "x", "start": "5", "end": "6"}, lambda _: Chain({5: 2, 6: 1}))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(h, json.loads(b)["height"], len(t)) for h, b, t in rows] == [(5, 5, 2), (6, 6, 1)]
    spark.dataSource.register(raw.RestSource)
    assert spark.read.format("ledger_rest").options(start=1, end=2, address="http://localhost:9").load().columns == ["block_height", "block", "transactions"]


def test_stream(spark, tmp_path):
    root, out, at = (str(tmp_path / n) for n in ("raw", "parquet", "checkpoint"))
    for heights in ((1, 2), (3, 3)):
        raw.ingest_range(Chain({h: 2 for h in range(1, 4)}), *heights, root, sleep=lambda s: None)
        incremental.watch(spark, root, out, at, once=True).awaitTermination()
        assert store.complete_heights(spark, out) == set(range(1, heights[1] + 1))


def test_only_files_of_todo_heights_are_read_once(spark, tmp_path, monkeypatch):
    root, out = str(tmp_path / "raw"), str(tmp_path / "parquet")
    raw.ingest_range(Chain({h: 2 for h in range(1, 9)}), 1, 8, root, sleep=lambda s: None)
    store.build(spark, root, out, [1, 2, 3, 4, 5])
    read = []
    for name in ("read_blocks", "read_ordered_transactions"):
        f = getattr(raw, name)
        monkeypatch.setattr(raw, name, lambda *a, f=f: (read.append(df := f(*a)), df)[1])
    assert store.build(spark, root, out, [4, 5, 6, 7])["created"] == [6, 7]
    files = [sorted(x.split("/")[-2] for x in df.inputFiles()) for df in read]
    assert files == [["0000006", "0000007"]] * 2
    assert store.build(spark, root, out, [4, 5, 6, 7])["created"] == [] and len(read) == 2
    assert not [n for n in os.listdir(out) if n.startswith("_staged")]


def _rows(heights, value):
    return [(h, f"h{h}", f"h{h - 1}", 1, 1, 1, 1, 1.0, "m", value, 1) for h in heights]


def test_a_load_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    tables = warehouse.Raw(spark, str(tmp_path))
    staged = lambda heights, v: warehouse.with_load_columns(spark.createDataFrame(_rows(heights, v), DATASETS["blocks"]))

    def load(df):
        touched = tables.touched("blocks", df, KEYS["blocks"])
        tables.publish("blocks", warehouse.upsert(tables.read("blocks", touched), df, KEYS["blocks"]), touched)

    seen = lambda: {r["block_height"]: r["nonce"] for r in tables.read("blocks").collect()}
    assert tables.version("blocks") is None and seen() == {}
    load(staged([1, 2, 3], 10))
    create = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None, **k: 1 / 0 if schema == "load string, block_height bigint" else create(data, schema, **k))
    with pytest.raises(ZeroDivisionError):
        load(staged([2, 3, 4], 20))
    monkeypatch.undo()
    assert seen() == {1: 10, 2: 10, 3: 10}
    os.makedirs(tmp_path / "blocks" / "versions" / "9")  # one that broke off before its marker
    assert tables.version("blocks") == 1 and seen() == {1: 10, 2: 10, 3: 10}
    load(staged([3, 4], 30))
    assert seen() == {1: 10, 2: 10, 3: 30, 4: 30}


def test_a_load_writes_touched_heights_alone(spark, tmp_path):
    tables = warehouse.Raw(spark, str(tmp_path))
    for heights, v in (([1, 2, 3], 1), ([2], 2), ([4], 3), ([1, 3], 4)):
        df = warehouse.with_load_columns(spark.createDataFrame(_rows(heights, v), DATASETS["blocks"]))
        touched = tables.touched("blocks", df, KEYS["blocks"])
        assert touched == set(heights)
        tables.publish("blocks", warehouse.upsert(tables.read("blocks", touched), df, KEYS["blocks"]), touched)
    assert sorted((r["block_height"], r["nonce"]) for r in tables.read("blocks").collect()) == [(1, 4), (2, 2), (3, 4), (4, 3)]
    assert sorted(tables.placed("blocks").values()) == [[1, 3], [2], [4]] and len(tables._versions("blocks")) == 2
    loads = [n for n in os.listdir(tmp_path / "blocks") if n.startswith("load-")]
    assert len(loads) == 4  # the first is of the version before
    plan = tables.read("blocks", {2})._jdf.queryExecution().toString()
    assert plan.count("FileScan") == 1


def test_a_row_that_moves_to_another_height(spark, tmp_path):
    tables = warehouse.Raw(spark, str(tmp_path))
    t = lambda h: warehouse.with_load_columns(spark.createDataFrame([(h, "b", "tx", 0, 1, 0, 1, 1, 1, 0, False)], DATASETS["transactions"]))
    for h in (5, 6):
        touched = tables.touched("transactions", t(h), KEYS["transactions"])
        tables.publish("transactions", warehouse.upsert(tables.read("transactions", touched), t(h), KEYS["transactions"]), touched)
    assert [r["block_height"] for r in tables.read("transactions").collect()] == [6]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k bigint, v string, n bigint")
    new = spark.createDataFrame([("B", 2, 21), ("C", 3, 30), ("m", None, 1)], "V string, K int, N int")
    once = warehouse.upsert(old, new, ["k"])
    want = {(1, "a", 10), (2, "B", 21), (3, "C", 30), (None, "n", 0), (None, "m", 1)}
    assert {tuple(r) for r in once.collect()} == want and once.columns == old.columns
    assert {tuple(r) for r in warehouse.upsert(once.where("k is not null"), new.where("K is not null"), ["k"]).collect()} == {x for x in want if x[0]}
    with pytest.raises(ValueError):
        warehouse.check_unique(new.union(new), ["K"])
    with pytest.raises(ValueError):
        warehouse.upsert(old, new.drop("N"), ["k"])


def test_models_and_tests(spark):
    data = golden.tables()
    led = golden.ledger(spark, data)
    sources = {n: warehouse.with_load_columns(getattr(led, n)) for n in DATASETS}
    models = warehouse.build(sources)
    assert len(models) == 8 and "loaded_at" in models["stg_blocks"].columns and "loaded_at" not in models["core_blocks"].columns
    assert models["core_blocks"].columns[-1] == "block_id" and models["core_transaction_inputs"].columns[:3] == ["txid", "input_index", "block_height"]
    assert models["core_transactions"].columns[0] == "txid" and dict(models["stg_blocks"].dtypes)["block_timestamp"] == "timestamp_ntz"
    tests = warehouse.data_tests(models)
    assert len(tests) == 26 and not {n for n, t in tests.items() if t().limit(1).count()}
    led = golden.ledger(spark, golden.broken(golden.MUTATIONS[22]))
    tests = warehouse.data_tests(warehouse.build({n: getattr(led, n) for n in DATASETS}))
    assert tests["t_unique_outputs_output_id"]().count() == 1
    warehouse.materialize(spark, sources, "core_test")
    assert spark.table("core_test.transactions").count() == 6 and spark.table("stg_blocks").count() == 3


def test_command_line(spark, tmp_path, capsys):
    base = ["--raw", str(tmp_path / "raw"), "--parquet", str(tmp_path / "parquet"), "--reports", str(tmp_path / "reports"), "--tables", str(tmp_path / "tables")]
    client = Chain({h: 2 for h in range(1, 120)})
    run = lambda *a: cli.main([*base, *a], client)
    assert run("fetch", "--start-height", "10", "--end-height", "9") == 2
    assert run("fetch", "--height", "10") == 0 and run("fetch", "--start-height", "11", "--count", "1") == 0
    assert run("fetch", "--start-height", "500", "--end-height", "500") == 1
    assert run("build", "--start-height", "10", "--end-height", "11") == 0 and run("build", "--height", "99") == 1
    assert run("build", "--start-height", "10") == 2
    assert run("load", "--start-height", "10", "--end-height", "11") == 2  # no report yet
    assert run("validate", "--start-height", "11", "--end-height", "10") == 2
    assert run("validate", "--start-height", "10", "--end-height", "12") == 1
    code = run("validate", "--start-height", "10", "--end-height", "11")
    report = json.load(open(tmp_path / "reports" / "validation_10_11.json"))
    failing = {c["id"] for c in report["checks"] if c["severity"] == "FAIL"}
    assert (code, failing) == (0, set())
    assert run("summarize", "--start-height", "10", "--end-height", "11") == 0 and run("explore") == 0
    assert run("load", "--start-height", "10", "--end-height", "11") == 0
    tables = warehouse.Raw(spark, str(tmp_path / "tables"))
    assert tables.read("transactions").count() == 4 and {"loaded_at", "source_file_name"} <= set(tables.read("blocks").columns)
    assert run("load", "--start-height", "10", "--end-height", "11") == 0  # again: nothing doubles
    assert tables.read("transactions").count() == 4 and tables.read("inputs").select(*KEYS["inputs"]).distinct().count() == 4
