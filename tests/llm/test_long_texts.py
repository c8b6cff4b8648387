"""Every query over texts that are longer than any slice, batch or piece that its code works on."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from basalt.llm import base, bpe, quality, toxicity, webp
from basalt.llm.queries import QUERIES

from .conftest import prose, write
from .test_dedup import line_brute, near_brute, removed_brute

BYTES = 7 << 20


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    long = prose(rng, 12_000).replace("\n", " ")
    long = " ".join(long[rng.randrange(1000) :] + " " + prose(rng, 900).replace("\n", " ") for _ in range(80))[:BYTES].strip()
    assert len(long) > 6 << 20
    other = long.split(" ")
    for k in range(0, len(other), 5000):
        other[k] = "changed"
    return [(1, prose(rng, 50)), (2, long), (3, "short\n" + prose(rng, 30)), (4, " ".join(other)), (5, None), (6, "x" * (3 << 20))]


@pytest.fixture(scope="module")
def path(spark, texts, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("long"))
    write(spark, where, "documents", [(i, t, "s") for i, t in texts], "doc_id bigint, text string, source string")
    write(spark, where, "labels", [(i, i % 2, (i // 2) % 2) for i, _ in texts], "doc_id bigint, quality int, toxic int")
    write(spark, where, "pages", [(i, f"http://x.org/{i % 2}", t) for i, t in texts] + [(7, "http://x.org/1", texts[1][1])], "page_id bigint, url string, html string")
    return where


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_lines(spark, path, texts):
    found = QUERIES["op1_lines"](spark, path).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in found) == line_brute(texts)
    assert {r["doc_id"] for r in found if r["n_removed"]} == {4}


def test_substrings(spark, path, texts):
    found = QUERIES["op2_substring"](spark, path).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed_brute(texts, 35)


def test_near_duplicates(spark, path, texts):
    found = QUERIES["op3_minhash"](spark, path).collect()
    want = near_brute(texts, 2)
    assert {r["doc_id"]: r["component_id"] for r in found} == want and want[4] == 2


def test_fingerprints_and_mixing(spark, path, texts):
    found = QUERIES["op4_fingerprint"](spark, path).collect()
    t = [x or "" for _, x in texts]
    want = {i: sha((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()) for (i, _), a, b in zip(texts, t, t[1:] + t[:1])}
    assert {r["doc_id"]: r["edited_sha256"] for r in found} == want
    found = QUERIES["op5_mixing"](spark, path).collect()
    assert found and all(r["text_sha256"] == sha((dict(texts)[r["doc_id"]] or "").encode()) for r in found)


def test_media(spark, path, texts):
    found = QUERIES["op6_webp"](spark, path).collect()
    assert {r["doc_id"]: r["payload_sha256"] for r in found} == {i: sha(webp.padded((t or "").encode())) for i, t in texts}


def test_scores(spark, path, texts):
    docs, labels = base.table(spark, path, "documents"), base.table(spark, path, "labels")
    rng = random.Random(2)
    few = [prose(rng, 60) + (" nitwit blockhead" * (k % 2)) for k in range(80)]
    y = np.arange(80) % 2
    for module in (toxicity, quality):
        model = module.fit(few, y)
        found = {r[0]: r[2] for r in module.score(docs.select("doc_id", "text"), model).collect()}
        for i, t in texts:
            raw = (t or "").encode()
            alone = (model.tag if module is toxicity else model.score)(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0]
            assert np.isclose(found[i], alone)
    assert QUERIES["op7_toxicity"](spark, path).count() == QUERIES["op9_quality"](spark, path).count() == len(texts)


def test_archives(spark, path, texts):
    found = QUERIES["op8_warc"](spark, path).collect()
    want = {i: (len((t or "").encode()), sha((t or "").encode())) for i, t in texts}
    assert all((r["payload_bytes"], r["payload_digest"]) == want[2 if r["page_id"] == 7 else r["page_id"]] for r in found) and len(found) == len(texts) + 1
    assert [r["refers_to"] for r in found if r["page_id"] == 7] == [2]


def test_tokens(spark, path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_file("word_bpe_49k.json"))
    found = {r["doc_id"]: r["ids_sha256"] for r in QUERIES["op10_bpe"](spark, path).collect()}
    for i, x in texts:
        if i != 6:  # the library takes the square of a word's length
            assert found[i] == sha(np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes())
