"""Line, substring and near dedup, components and automata, against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from basalt.llm import automaton, base, components, linking, lines, neardup, substring
from basalt.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


class Union:
    def __init__(self, items):
        self.p = {x: x for x in items}

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def near_brute(rows, n):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            w = WORD.findall(lower(t or ""))
            sets[i].append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    u = Union(sets)
    for (i, a), (j, b) in itertools.combinations([(i, s) for i, ss in sets.items() for s in ss], 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            u.join(i, j)
    return {i: u.find(i) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, folder, rows, words):
    docs = base.table(spark, folder, "documents")
    found = neardup.near_duplicates(docs, words=words).collect()
    want = near_brute(rows, words)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_different_texts_of_a_doc_id_are_one_document(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (7, ""), (8, c), (9, " "), (10, c + " end")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = near_brute(rows, 5)
    assert len(found) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in found)
    assert {r["doc_id"] for r in found if r["kept"]} == {3, 8, 9}


def test_no_link_is_lost_beside_the_pivot(spark):
    """A chain: neighbours are linked, others are not, and all share a bucket."""
    rng = random.Random(1)
    s = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(s)))
        for k in rng.sample(range(120), 5):
            s[k] = f"x{i}.{k}"
    rng.shuffle(rows)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    want = near_brute(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_blocks_lose_no_link(spark, rows, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK_SHINGLES", 300)
    docs = spark.createDataFrame([x for x in rows if x[0] is not None], "doc_id bigint, text string")
    found = neardup.near_duplicates(docs, words=2).collect()
    want = near_brute(rows, 2)
    assert all(r["component_id"] == want[r["doc_id"]] for r in found)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    found = {r["id"]: r["root"] for r in components.components(df, base.Scratch(spark, "t")).collect()}
    assert found == {x: u.find(x) for x in u.p if u.find(x) != x}
    one = {r["u"]: r["v"] for r in components._local(df.coalesce(1)).collect()}
    assert one == found
    assert components.components(df.limit(0), base.Scratch(spark, "t")).count() == 0


def removed_brute(rows, n):
    seqs = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + n]) for w in seqs for k in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, seqs):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("shard", [substring.SHARD_WORDS, 40])
def test_substrings(spark, folder, rows, monkeypatch, shard):
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    found = QUERIES["op2_substring"](spark, folder).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed_brute(rows, 35)
    assert sum(r["n_removed"] for r in found) > 0


def test_automaton_counts_windows():
    rng = random.Random(9)
    for _ in range(60):
        seqs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 25))), rng.randint(1, 3)) for _ in range(rng.randint(1, 6))]
        a = automaton.SuffixAutomaton()
        for s, n in seqs:
            a.add(s, n)
        q = "".join(rng.choice("abc") for _ in range(30))
        for size in (1, 3, 6):
            for s in [q, *[x for x, _ in seqs]]:
                want = [sum(n for t, n in seqs for j in range(len(t)) if t[j : j + size] == s[k : k + size]) for k in range(len(s) - size + 1)]
                assert a.windows(s, size) == want


def test_against_a_reference(spark):
    rng = random.Random(2)
    passage = " ".join(rng.choice(["aa", "bb", "cc", "dd"]) + str(rng.randrange(50)) for _ in range(50))
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing here"), (3, None)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["kept"] for r in substring.against(docs, [passage, None, ""]).collect()}
    assert found == {1: "before after", 2: "nothing here", 3: ""}


def line_kept(rows):
    """doc_id, text, its lines and those that are kept, of every row."""
    sets, first = {}, {}
    keyed = sorted({(i is not None, i or 0, t): None for i, t in rows if t is not None}, key=lambda x: x[:2])
    for known, i, t in keyed:
        for k, x in enumerate(t.split("\n")):
            if x := lines.normal(x):
                b = x.encode()
                sets[x] = {b[j : j + lines.CHARS] for j in range(max(1, len(b) - lines.CHARS + 1))}
                first[x] = min(first.get(x, (True, 1 << 60, 0)), (known, i, k))
    u = Union(sets)
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            u.join(a, b)
    keep = {}
    for x in sets:
        keep[u.find(x)] = min(keep.get(u.find(x), (True, 1 << 60, 0)), first[x])
    for i, t in rows:
        ls = [] if t is None else t.split("\n")
        yield i, t, ls, [x for k, x in enumerate(ls) if not lines.normal(x) or keep[u.find(lines.normal(x))] == (i is not None, i or 0, k)]


def line_brute(rows):
    return Counter((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, _, ls, kept in line_kept(rows))


def test_lines(spark, folder, rows):
    found = QUERIES["op1_lines"](spark, folder).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in found) == line_brute(rows)
    assert sum(r["n_removed"] for r in found) > 0


def test_lines_with_one_letter_or_word_changed(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(6))
    rows, letters, words = [], [], []
    for k, n in enumerate(range(30, 131, 5)):
        w = [word() for _ in range(n // 7 + 1)]
        text = " ".join(w)[:n]
        other = text[: n // 2] + "x" + text[n // 2 + 1 :]
        w[len(w) // 2] = word()
        rows += [(3 * k, text), (3 * k + 1, other), (3 * k + 2, " ".join(w)[:n])]
        letters += [3 * k + 1] * (n >= 50)
        words += [3 * k + 2] * (n >= 100)
    found = lines.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    gone = {r["doc_id"] for r in found if r["n_removed"]}
    assert gone >= {*letters, *words}
    assert not any(i % 3 == 0 for i in gone)
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in found) == line_brute(rows)


def test_line_columns_stay(spark, folder):
    docs = base.table(spark, folder, "documents")
    out = lines.line_dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and "__n_lines" in out.columns
    assert out.count() == docs.count()


def test_signatures_estimate_similarity():
    rng = random.Random(4)
    import numpy as np

    from basalt.llm.shingles import distinct, signatures

    text = "".join(rng.choice("abcdefgh ") for _ in range(600)).encode()
    other = text[:520] + "".join(rng.choice("abcdefgh ") for _ in range(80)).encode()
    low = np.frombuffer(text + other + b"\xff" * 8, np.uint8)
    start, end = np.array([0, 600]), np.array([600, 1200])
    v, at = distinct(*lines.shingles(low, start, end))
    a, b = set(v[: at[1]].tolist()), set(v[at[1] :].tolist())
    share = len(a & b) / len(a | b)
    from basalt.llm.words import mix

    s = signatures(mix(v), at, 400)
    assert abs((s[0] == s[1]).mean() - share) < 0.08
    m = lines.bin_minima(low, start, end, 96)
    assert abs((m[0] == m[1]).mean() - share) < 0.16


def test_lines_of_a_buffer():
    import numpy as np

    texts = ["a\n B \n\n", "", "\n", "  \t", "x", "Ab\n\nÉ q\r\n"]
    raw = [t.encode() for t in texts]
    x = lines.Lines(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [(d, k, lines.normal(y).encode()) for d, t in enumerate(texts) for k, y in enumerate(t.split("\n")) if lines.normal(y)]
    assert list(zip(x.doc.tolist(), x.number.tolist(), x.bytes(np.arange(len(x.id))))) == want


@pytest.mark.parametrize("name", ["op1_lines", "op2_substring", "op3_minhash"])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def thue_morse(n):
    """A word of n bytes and its complement; sums of their bytes' multiples by powers are equal modulo 2^64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 2048, 8192])
def test_words_built_to_collide(spark, tmp_path, size):
    from .conftest import write

    x, y = thue_morse(size)
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(1, x), (2, y), (3, f"{x} {rest}"), (4, f"{y} {rest}")]
    write(spark, str(tmp_path), "documents", rows, "doc_id bigint, text string")
    found = QUERIES["op2_substring"](spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed_brute(rows, 35)
    assert not any(r["n_removed"] for r in found)
    found = QUERIES["op3_minhash"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == near_brute(rows, 2)


def test_links_are_confirmed_by_words():
    same = neardup.by_words(2, 80)
    assert same(b"a b c", b"a b c") and not same(b"a b c", b"a b d") and not same(b"", b"") and same(b"a", b"a") and not same(b"a", b"b")
    import numpy as np

    sets = [np.array([1, 2], np.uint64)] * 3
    assert linking.links(sets, [0, 1, 2], 80) == [(0, 1), (0, 2)]
    assert linking.links(sets, [0, 1, 2], 80, lambda i, j: i > 0) == [(1, 2)]


@pytest.mark.parametrize("bits", [0, 3])
def test_lines_whose_ids_collide(spark, rows, bits):
    few = [x for x in rows if x[1] is None or len(x[1]) < 2000][::2]
    found = lines.line_dedup(spark.createDataFrame(few, "doc_id bigint, text string"), id_bits=bits).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in found) == line_brute(few)


def test_long_lines_are_cut_without_a_trace(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    raw = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (3, 5, 700, 64, 68, 1)]
    low = np.frombuffer(b"".join(raw) + b"\xff" * 8, np.uint8)
    end = np.cumsum([len(x) for x in raw])
    start = end - [len(x) for x in raw]
    want = lines.bin_minima(low, start, end, 48), lines.open_lines(pa.array(raw, pa.binary()))
    monkeypatch.setattr(lines, "PART", 32)
    monkeypatch.setattr(lines, "SLICE", 100)
    assert (lines.bin_minima(low, start, end, 48) == want[0]).all()
    assert all((a == b).all() for a, b in zip(lines.open_lines(pa.array(raw, pa.binary())), want[1], strict=True))
