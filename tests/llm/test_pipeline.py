"""The pipeline's stages, each on its own input, against brute force; and their chain."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline as pipeline
from basalt.llm import base, bpe, mixing, toxicity

from .conftest import write
from .test_dedup import line_kept, near_brute

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return base.table(spark, folder, "documents")


def _pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_order_of_stages():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "tokens"]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_stay(spark, docs, folder, empty, name):
    assert STAGES[name](spark, docs, folder).columns == docs.columns
    none = base.table(spark, empty, "documents")
    out = STAGES[name](spark, none, empty)
    assert out.columns == none.columns and out.count() == 0


def not_toxic(spark, docs, folder, rows):
    field = toxicity.train(docs, base.table(spark, folder, "labels"))
    score = lambda raw: field.tag(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0]
    return [(i, t) for i, t in rows if score((t or "").encode()) < 0.5]


def lines_gone(rows):
    out = [(i, None if t is None else "\n".join(kept), len(ls) > len(kept)) for i, t, ls, kept in line_kept(rows)]
    return [(i, t) for i, t, less in out if not (less and not t.split())]


def near_gone(rows):
    root = near_brute(rows, 5)
    return [(i, t) for i, t in rows if i is None or root[i] == i]


def test_toxic_documents_go(spark, docs, folder, rows):
    assert _pairs(STAGES["toxicity"](spark, docs, folder)) == Counter(not_toxic(spark, docs, folder, rows))


def test_lines_go(spark, docs, folder, rows):
    out = STAGES["line dedup"](spark, docs, folder)
    want = lines_gone(rows)
    assert _pairs(out) == Counter(want) and len(want) < len(rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_one_of_each_group_stays(spark, docs, folder, rows):
    assert _pairs(STAGES["near dedup"](spark, docs, folder)) == Counter(near_gone(rows))


def test_the_filters_one_after_another(spark, tmp_path):
    """Toxicity, lines and near dedup on the documents of the smallest table, against brute force on what the stage before gave;
    near copies that line dedup leaves are found."""
    rng = random.Random(12)
    rows = [(r["doc_id"], r["text"]) for r in base.table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect() if len(r["text"] or "") < 3000]
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3))
    w = [word() for _ in range(120)]
    # No line of the second is like one of the first, but most of their shingles are the same.
    rows += [(10**6, "\n".join(" ".join(w[k : k + 12]) for k in range(0, 120, 12))), (10**6 + 1, "\n".join(" ".join(w[max(0, k - 6) : k + 6]) for k in range(0, 121, 12)))]
    rows += [(10**6 + 2, rows[-1][1]), (10**6 + 3, rows[-1][1] + "\n\n")]
    write(spark, str(tmp_path), "documents", rows, "doc_id bigint, text string")
    base.table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs = base.table(spark, str(tmp_path), "documents")
    want = not_toxic(spark, docs, str(tmp_path), rows)
    for name, brute in (("toxicity", None), ("line dedup", lines_gone), ("near dedup", near_gone)):
        docs = base.Scratch(spark, "chain").keep(STAGES[name](spark, docs, str(tmp_path)))
        before, want = want, brute(want) if brute else want
        assert _pairs(docs) == Counter(want), name
        assert name == "toxicity" or len(want) < len(before), name
    assert all(t is None or t.split() for i, t in want if dict(rows)[i] and dict(rows)[i].split())


def test_mixing_counts(spark, docs, folder):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = Counter(r[0] for r in c.sql(f"WITH {mixing.mixing_sql('documents')} SELECT doc_id FROM mixed").fetchall())
    assert Counter(r["doc_id"] for r in STAGES["mixing"](spark, docs, folder).collect()) == want


def test_tokens_are_given(spark, docs, folder):
    found = STAGES["tokens"](spark, docs, folder).collect()
    assert any(r["ids"] for r in found)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in found)


def test_tokens(spark, docs, folder, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_file("word_bpe_49k.json"))
    want = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    found = STAGES["tokens"](spark, docs, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in found) == want


def test_the_chain(spark, docs, folder):
    """run() gives what the stages give one after another."""
    df = docs
    for _, stage in pipeline.STAGES:
        df = base.Scratch(spark, "chain").keep(stage(spark, df, folder))
    key = lambda d: Counter(tuple(r) for r in d.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert key(pipeline.run(spark, folder)) == key(df)
