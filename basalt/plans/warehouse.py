"""Staging and core models, their data tests, and gated, idempotent upserts into the raw layer."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_to_timestamp, surrogate, vsize
from ..operators.ledger import Ledger
from ..sources.schemas import DATASETS, KEYS
from .gate import load_report

LOADED = {"loaded_at": "timestamp_ntz", "source_file_name": "string"}


def with_load_columns(df: DataFrame, source_file: str = "data.parquet") -> DataFrame:
    """What the raw layer adds. The file's name alone is kept, as every partition has one file of that name."""
    return df.withColumn("loaded_at", F.current_timestamp().cast("timestamp_ntz")).withColumn("source_file_name", F.lit(source_file))


def upsert(target: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """The target with staged rows in place of those with their keys, wherever in the target these are; nothing is deleted.
    Columns are matched by name whatever their case. Rows of a null key are inserted, as null matches nothing."""
    by = {c.lower(): c for c in staged.columns}
    missing = [c for c in target.columns if c.lower() not in by]
    if missing:
        raise ValueError(f"staged rows lack {missing}")
    staged = staged.select(*[F.col(by[c.lower()]).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    return target.join(staged.select(*keys).distinct(), keys, "left_anti").unionByName(staged)


def check_unique(staged: DataFrame, keys: list[str]) -> None:
    """Two staged rows of one key would make the result depend on their order."""
    twice = staged.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"staged rows repeat the key {twice[0].asDict()}")


@dataclass
class Raw:
    """Raw tables by height, in a folder for each load, and versions that say which load has a height's rows.

    A version is a small table of (load, block_height), written as a whole and numbered; the highest one that is complete is the
    current one. So a reader sees a load or none of it, a load that breaks off leaves the version before as it was, and heights that a
    load does not touch are not written again."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        """Numbers of complete versions, those that have the marker Spark writes last."""
        fs, p = self._fs(f"{self.root}/{name}/versions/*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()) for s in fs.globStatus(p) or [])

    def version(self, name: str) -> int | None:
        return max(self._versions(name), default=None)

    def schema(self, name: str) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in DATASETS[name]) + ", loaded_at timestamp_ntz, source_file_name string"

    def placed(self, name: str) -> dict[str, list[int]]:
        """Heights by the load that has their rows."""
        v, out = self.version(name), {}
        if v is not None:
            for r in self.spark.read.schema("load string, block_height bigint").parquet(f"{self.root}/{name}/versions/{v}").collect():
                out.setdefault(r["load"], []).append(r["block_height"])
        return out

    def read(self, name: str, heights: set[int] | None = None) -> DataFrame:
        """The table, or these heights of it alone."""
        schema = self.schema(name)
        out = self.spark.createDataFrame([], schema)
        for load, held in sorted(self.placed(name).items()):
            held = [h for h in held if heights is None or h in heights]
            if held:
                df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{load}").where(F.col("block_height").isin(held))
                out = out.unionByName(df.select(*out.columns))
        return out

    def touched(self, name: str, staged: DataFrame, keys: list[str]) -> set[int]:
        """Heights that hold rows of the staged keys, and those of the staged rows."""
        old = self.read(name).select("block_height", *[k for k in keys if k != "block_height"])
        old = old.join(staged.select(*keys).distinct(), keys, "left_semi").select("block_height")
        return {r[0] for r in old.union(staged.select("block_height")).distinct().collect()}

    def publish(self, name: str, df: DataFrame, heights: set[int]) -> None:
        """Makes df the rows of these heights. Loads of which no height is left, and versions before the last, go."""
        load, before = f"load-{uuid.uuid4().hex}", self.placed(name)
        df.repartition("block_height").write.partitionBy("block_height").parquet(f"{self.root}/{name}/{load}")
        rows = [(x, h) for x, held in before.items() for h in held if h not in heights] + [(load, h) for h in sorted(heights)]
        known = self._versions(name)
        self.spark.createDataFrame(rows, "load string, block_height bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/versions/{max(known, default=0) + 1}")
        used = {x for x, _ in rows} | set(before)  # readers of the version before may still be at it
        for old in known[:-1]:
            self._remove(f"{self.root}/{name}/versions/{old}")
        fs, p = self._fs(f"{self.root}/{name}/load-*")
        for s in fs.globStatus(p) or []:
            if s.getPath().getName() not in used:
                self._remove(s.getPath().toString())

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


@dataclass
class LoadResult:
    loaded: list[tuple[int, str]] = field(default_factory=list)
    missing: list[tuple[int, str]] = field(default_factory=list)
    failed: list[tuple[int, str, str]] = field(default_factory=list)


def load_range(raw: Raw, parts: Callable[[str], DataFrame], heights_of: Callable[[str], set[int]], reports: str, start: int, end: int) -> LoadResult:
    """Upserts the heights' partitions of all datasets, if the gate passed for exactly this range. All heights of a dataset go
    at once; a dataset that fails does not keep the others from loading."""
    load_report(reports, start, end)
    result = LoadResult()
    for name in DATASETS:
        have = heights_of(name)
        wanted = [h for h in range(start, end + 1) if h in have]
        result.missing += [(h, name) for h in range(start, end + 1) if h not in have]
        if not wanted:
            continue
        try:
            staged = with_load_columns(parts(name).where(F.col("block_height").isin(wanted)))
            check_unique(staged, KEYS[name])
            touched = raw.touched(name, staged, KEYS[name])
            raw.publish(name, upsert(raw.read(name, touched), staged, KEYS[name]), touched)
            result.loaded += [(h, name) for h in wanted]
        except Exception as e:  # the dataset is reported; the others go on
            result.failed += [(h, name, str(e)) for h in wanted]
    return result


# Models


def _cast(df: DataFrame, name: str, rename: dict[str, Column]) -> DataFrame:
    cols = []
    for f in DATASETS[name]:
        cols.append(rename[f.name] if f.name in rename else F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*cols, *[c for c in LOADED if c in df.columns])


def stg_blocks(raw: DataFrame) -> DataFrame:
    return _cast(raw, "blocks", {"timestamp": epoch_to_timestamp(F.col("timestamp")).alias("block_timestamp")})


def stg_transactions(raw: DataFrame) -> DataFrame:
    return _cast(raw, "transactions", {})


def stg_inputs(raw: DataFrame) -> DataFrame:
    return _cast(raw, "inputs", {"sequence": F.col("sequence").cast("bigint").alias("sequence_number")})


def stg_outputs(raw: DataFrame) -> DataFrame:
    return _cast(raw, "outputs", {})


def core_blocks(stg: DataFrame) -> DataFrame:
    return stg.drop(*LOADED).withColumn("block_id", surrogate(F.col("block_height"), F.col("block_hash")))


def core_transactions(stg: DataFrame) -> DataFrame:
    rest = [c for c in stg.columns if c not in (*LOADED, "txid")]
    return stg.select("txid", *[c for c in ("block_height", "block_hash") if c in rest], *[c for c in rest if c not in ("block_height", "block_hash")])


def core_inputs(stg: DataFrame) -> DataFrame:
    lead = ["txid", "input_index", "block_height"]
    return stg.select(*lead, *[c for c in stg.columns if c not in (*LOADED, *lead)], surrogate(F.col("txid"), F.col("input_index")).alias("input_id"))


def core_outputs(stg: DataFrame) -> DataFrame:
    lead = ["txid", "output_index", "block_height"]
    return stg.select(*lead, *[c for c in stg.columns if c not in (*LOADED, *lead)], surrogate(F.col("txid"), F.col("output_index")).alias("output_id"))


@dataclass(frozen=True)
class Model:
    name: str
    source: str
    build: Callable[[DataFrame], DataFrame]
    materialized: str


MODELS = [
    Model("stg_blocks", "blocks", stg_blocks, "view"),
    Model("stg_transactions", "transactions", stg_transactions, "view"),
    Model("stg_transaction_inputs", "inputs", stg_inputs, "view"),
    Model("stg_transaction_outputs", "outputs", stg_outputs, "view"),
    Model("core_blocks", "stg_blocks", core_blocks, "table"),
    Model("core_transactions", "stg_transactions", core_transactions, "table"),
    Model("core_transaction_inputs", "stg_transaction_inputs", core_inputs, "table"),
    Model("core_transaction_outputs", "stg_transaction_outputs", core_outputs, "table"),
]


def build(sources: dict[str, DataFrame], only: str | None = None) -> dict[str, DataFrame]:
    """Every model by name, from sources by dataset name."""
    known = dict(sources)
    for m in MODELS:
        known[m.name] = m.build(known[m.source])
    return {m.name: known[m.name] for m in MODELS if only in (None, m.name)}


def materialize(spark: SparkSession, sources: dict[str, DataFrame], database: str = "core") -> None:
    """Staging as views, core as tables of a database."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for m in MODELS:
        df = build(sources)[m.name]
        if m.materialized == "view":
            df.createOrReplaceTempView(m.name)
        else:
            df.write.mode("overwrite").format("parquet").saveAsTable(f"{database}.{m.name.removeprefix('core_')}")


# Data tests: a test fails where its query gives rows


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_null(df: DataFrame, column: str, where: str = "true") -> DataFrame:
    return df.where(where).where(F.col(column).isNull())


def nonnegative(df: DataFrame, column: str, where: str = "true") -> DataFrame:
    return df.where(where).where(F.col(column) < 0)


def positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) <= 0)


def relationships(child: DataFrame, column: str, parent: DataFrame, to: str) -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(to).alias("__to")).distinct(), F.col(column) == F.col("__to"), "left_anti")


def tx_counts(b: DataFrame, t: DataFrame) -> DataFrame:
    n = t.groupBy("block_height").agg(F.count("txid").alias("n"))
    per = b.groupBy("block_height", F.col("transaction_count").alias("reported")).agg(F.count(F.lit(1)).alias("copies"))
    return per.join(n, "block_height", "left").select("block_height", "reported", (F.coalesce("n", F.lit(0)) * F.col("copies")).alias("actual")).where("actual <> reported")


def one_coinbase(t: DataFrame) -> DataFrame:
    """Blocks without any coinbase transaction are not seen here."""
    return t.where("is_coinbase").groupBy("block_height").agg(F.count(F.lit(1)).alias("coinbase_count")).where("coinbase_count <> 1")


def data_tests(models: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """The 21 generic and 5 singular tests, by name."""
    b, t, i, o = (models[f"core_{n}"] for n in ("blocks", "transactions", "transaction_inputs", "transaction_outputs"))
    from ..operators.checks import fee_mismatches, unresolved_inputs

    # The singular tests have no window: one that holds all heights.
    every = Ledger(b, t, i, o).window(-(1 << 62), 1 << 62)
    ordinary = "not is_coinbase"
    return {
        "t_unique_blocks_block_id": lambda: unique(b, "block_id"),
        "t_unique_transactions_txid": lambda: unique(t, "txid"),
        "t_unique_inputs_input_id": lambda: unique(i, "input_id"),
        "t_unique_outputs_output_id": lambda: unique(o, "output_id"),
        "t_not_null_blocks_block_height": lambda: not_null(b, "block_height"),
        "t_not_null_blocks_block_hash": lambda: not_null(b, "block_hash"),
        "t_not_null_blocks_block_id": lambda: not_null(b, "block_id"),
        "t_not_null_transactions_txid": lambda: not_null(t, "txid"),
        "t_not_null_inputs_input_id": lambda: not_null(i, "input_id"),
        "t_not_null_outputs_output_id": lambda: not_null(o, "output_id"),
        "t_not_null_inputs_previous_txid": lambda: not_null(i, "previous_txid", ordinary),
        "t_not_null_inputs_previous_vout_index": lambda: not_null(i, "previous_vout_index", ordinary),
        "t_relationships_transactions_blocks": lambda: relationships(t, "block_height", b, "block_height"),
        "t_relationships_inputs_transactions": lambda: relationships(i, "txid", t, "txid"),
        "t_relationships_outputs_transactions": lambda: relationships(o, "txid", t, "txid"),
        "t_nonnegative_blocks_transaction_count": lambda: nonnegative(b, "transaction_count"),
        "t_nonnegative_transactions_transaction_index": lambda: nonnegative(t, "transaction_index"),
        "t_nonnegative_transactions_fee_sats": lambda: nonnegative(t, "fee_sats", ordinary),
        "t_nonnegative_inputs_previous_output_value_sats": lambda: nonnegative(i, "previous_output_value_sats"),
        "t_nonnegative_outputs_value_sats": lambda: nonnegative(o, "value_sats"),
        "t_positive_blocks_weight_units": lambda: positive(b, "weight_units"),
        "t_singular_block_tx_counts_match": lambda: tx_counts(b, t),
        "t_singular_one_coinbase_per_block": lambda: one_coinbase(t),
        "t_singular_internal_inputs_resolve_uniquely": lambda: unresolved_inputs(every),
        "t_singular_fee_arithmetic_matches": lambda: fee_mismatches(every),
        "t_singular_vsize_matches_formula": lambda: t.where(F.col("vsize") != vsize(F.col("weight_units"))).select("txid", "weight_units", "vsize"),
    }
