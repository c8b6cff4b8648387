"""The toxicity field and the quality bags: held-out accuracy, and the field's marginals against all paths."""

import itertools
import random
import zlib

import numpy as np
import pytest

from basalt.llm import labelled as labelled_rows
from basalt.llm import quality, toxicity
from basalt.llm.queries import QUERIES

from .conftest import WORDS, prose

BAD = ["scoundrel", "blockhead", "nitwit"]


def labelled(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = prose(rng, rng.randint(30, 120))
        toxic, good = i % 4 == 0, i % 3 != 0
        if not good:
            t = " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in t.split())
        if toxic:
            w = t.split(" ")
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
            t = " ".join(w)
        noise = rng.random() < 0.03
        rows.append((i, t, int(good), int(toxic) if not noise else 1 - int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labelled"))
    rows = labelled()
    spark.createDataFrame([(i, t, None, None, None) for i, t, _, _ in rows] + [(None, None, None, None, None), (900, "", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}


def test_toxicity(spark, tables):
    path, rows = tables
    found = QUERIES["op7_toxicity"](spark, path).collect()
    assert len(found) == len(rows) + 2
    right = n = 0
    for r in found:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if i in rows:
            right += r["predicted"] == int(i % 4 == 0)
            n += 1
            if r["predicted"]:
                raw = rows[i][1].encode()
                words = {raw[a:b].decode().lower() for a, b in zip(r["toxic_spans"][::2], r["toxic_spans"][1::2])}
                assert any(b in w for w in words for b in BAD)
        else:
            assert r["predicted"] == 0
    assert right / n > 0.97


def test_quality(spark, tables):
    path, rows = tables
    found = QUERIES["op9_quality"](spark, path).collect()
    right = [r["predicted"] == rows[r["doc_id"]][2] for r in found if r["doc_id"] in rows and r["held_out"]]
    assert len(right) > 50 and np.mean(right) > 0.95
    for r in found:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_held_out_labels_do_not_matter(spark, tables, tmp_path):
    from pyspark.sql import functions as F

    path, _ = tables
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    crc = F.crc32(F.col("doc_id").cast("string"))
    changed = labels.withColumn("toxic", F.when(crc % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(crc % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, changed)
    assert (a.keys == b.keys).all() and np.allclose(a.own, b.own) and np.allclose(a.score, b.score)
    a, b = quality.train(docs, labels), quality.train(docs, changed)
    assert all(np.allclose(a.p[k], b.p[k]) for k in a.p)


def test_marginals_by_all_paths():
    rng = np.random.default_rng(0)
    steps = rng.normal(size=(2, 2))
    sizes = [1, 4, 0, 6]
    at = np.cumsum([0, *sizes])
    u = rng.normal(size=at[-1])
    p = toxicity.marginals(u, at, steps)
    for a, b in zip(at[:-1], at[1:]):
        n = b - a
        weight = np.zeros(n)
        total = 0.0
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(u[a + k] for k in range(n) if path[k]) + sum(steps[path[k], path[k + 1]] for k in range(n - 1)))
            total += w
            weight += w * np.array(path)
        assert np.allclose(p[a:b], weight / total)


def test_long_chains_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    steps = rng.normal(size=(2, 2)) * 2
    at = np.cumsum([0, 5, 900, 0, 1, 37, 2500])
    u = rng.normal(size=at[-1]) * 5
    want = toxicity.passes(u, at, steps)
    monkeypatch.setattr(toxicity, "LONG_CHAIN", 8)
    assert all(np.allclose(a, b) for a, b in zip(toxicity.passes(u, at, steps), want))


def test_samples_are_by_label_and_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i % 7)) for i in range(500)] + [(3, "again"), (7, "y" * 5000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 50 == 7)) for i in range(2000)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    texts, y, shift = labelled_rows.sample(docs, labels, "toxic", 5, 0, 60)
    rare = sum(i % 50 == 7 and zlib.crc32(str(i).encode()) % 5 != 0 for i in range(500))
    every = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(500))
    assert (y == 1).sum() == rare and (y == 0).sum() == 30 and len(texts) == len(y)
    assert np.isclose(shift, np.log(rare / (every - rare)) - np.log(rare / 30))
    texts, y, _ = labelled_rows.sample(docs, labels, "toxic", 5, 0, 60, 200)
    assert 0 < sum(map(len, texts)) <= 200
    assert labelled_rows.sample(docs.limit(0), labels, "toxic", 5, 0)[0] == []


def test_columns_of_these_names_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = toxicity.score(docs, toxicity.fit([], np.zeros(0, np.int64)))
    assert out.columns == [*docs.columns, "__toxic_score", "toxic_spans"] and out.where("__toxic_score = 0.5").count() == docs.count()
    out = quality.score(out.withColumnRenamed("toxic_spans", "quality_score"), quality.fit([], np.zeros(0, np.int64)))
    assert out.columns[-2:] == ["__quality_score", "quality_passage"]


def test_gradients_of_the_bags():
    rng = np.random.default_rng(1)
    at = np.array([0, 3, 4, 9])
    x = rng.normal(size=(9, quality.FEATURES))
    y = np.array([1, 0, 1])
    f = lambda *s: rng.normal(size=s)
    p = {"W": f(quality.FEATURES, 5), "b": f(5), "V": f(5, 4), "U": f(5, 4), "w": f(4), "c": f(5), "d": f(1)}
    m = quality.Bags(p, np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    loss = lambda: float(-np.mean(y * np.log(m.forward(x, at)["s"]) + (1 - y) * np.log(1 - m.forward(x, at)["s"])) + sum(5e-5 * (v**2).sum() for v in p.values()))
    grads = m.backward(m.forward(x, at), at, y)
    for k, v in p.items():
        i = tuple(rng.integers(0, s) for s in v.shape)
        old = v[i]
        v[i] = old + 1e-5
        hi = loss()
        v[i] = old - 1e-5
        lo = loss()
        v[i] = old
        assert np.isclose(grads[k][i], (hi - lo) / 2e-5, atol=1e-6)


def test_passages_cover_texts():
    texts = [b"", b"a\n\nb", b"", "é".encode() * 3000, b"x" * 5000 + b"\n", b"\n"]
    off = np.cumsum([0, *map(len, texts)])
    starts, at = quality.passages(np.frombuffer(b"".join(texts), np.uint8), off)
    assert (np.diff(at) >= 1).all() and len(at) == len(texts) + 1 and at[-1] == len(starts) - 1
    for k, t in enumerate(texts):
        assert starts[at[k]] == off[k]
        pieces = [b"".join(texts)[starts[j] : min(starts[j + 1], off[k + 1])] for j in range(at[k], at[k + 1])]
        assert b"".join(pieces) == t and all(p.decode() is not None for p in pieces)


def test_odd_tables(spark, folder, empty, rows):
    for name in ("op7_toxicity", "op9_quality"):
        assert QUERIES[name](spark, empty).count() == 0
        assert QUERIES[name](spark, folder).count() == len(rows)


def test_words_are_words():
    assert len(WORDS) == 80
