"""WebP, BPE, fingerprints, WARC and mixing."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from basalt.llm import base, bpe, fingerprint, mixing, warc, webp
from basalt.llm.queries import ORACLES, QUERIES

# WebP


def test_webp_query(spark, folder, rows):
    found = QUERIES["op6_webp"](spark, folder).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == Counter(want)
    by = defaultdict(set)
    for r in found:
        by[r["payload_sha256"], r["n_bytes"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(x) == 1 for x in by.values())


def test_media_columns(spark, folder, rows):
    docs = base.table(spark, folder, "documents")
    assert webp.to_media(docs).columns == [*docs.columns, "__media"]
    out = webp.from_media(webp.to_media(docs), "__media").select("text", "pixels").collect()
    assert all(bytes(r["pixels"]) == webp.padded((r["text"] or "").encode()) for r in out) and len(out) == len(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=9000), max_size=4))
def test_payloads_round_trip(payloads):
    padded = [webp.padded(p) for p in payloads]
    assert webp.load(webp.store(padded)) == padded


def _streams(media):
    while media:
        stream, end = webp.open_webp(media)
        yield stream
        media = media[end:]


def test_stored_form_by_the_general_decoder():
    p = webp.padded(bytes(random.Random(1).choices(range(256), weights=range(1, 257), k=3000)))
    px = webp.decode(webp.store([p])[0])
    assert px.shape == (6, 192, 4) and px[:, :, :3].tobytes() == p and (px[:, :, 3] == 255).all()


def test_stored_images_use_the_method(monkeypatch):
    """The documents' own images have back-references, colour caches and palettes, read by both decoders alike."""
    texts = [r[0] for r in duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()] + ["", "ab" * 900]
    payloads = [webp.padded(t.encode()) for t in texts]
    streams = [s for m in webp.store(payloads) for s in _streams(m)]
    seen, extra = Counter(), webp._extra

    def counted(bits, s):
        seen["copies"] += 1
        return extra(bits, s)

    monkeypatch.setattr(webp, "_extra", counted)
    heads = [webp.start(s) for s in streams]
    for (_, h), s in zip(heads, streams):
        seen["caches"] += h.cache > 0
        seen["palettes"] += any(t[0] == 3 for t in h.transforms)
        seen["hits"] += h.cache > 0 and h.codes[0][0].bits > 0 and int((h.codes[0][0].table & 0xFFFF).max()) >= 280
    assert all((a == webp.undo(h, webp.pixels(bits, h))).all() for a, (bits, h) in zip(webp.decode_all(streams), heads))
    assert seen["copies"] > len(texts) and seen["caches"] > len(texts) / 2 and seen["hits"] > len(texts) / 2 and seen["palettes"] >= 2, seen


def test_caches_make_images_smaller(monkeypatch):
    text = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE length(text) BETWEEN 4000 AND 9000 ORDER BY doc_id LIMIT 20").fetchall()
    payloads = [webp.padded(t.encode()) for (t,) in text]
    with_cache = sum(map(len, webp.store(payloads)))
    monkeypatch.setattr(webp, "CACHE_SHARE", 2.0)
    without = webp.store(payloads)
    assert webp.load(without) == payloads and with_cache < sum(map(len, without))


def test_copies_at_the_edges():
    rng = random.Random(5)
    for n in (1, 2, 3, 192, 6144, 6145, 9000):
        for make in (lambda: b"\xff" * 3 * n, lambda: bytes(rng.choices(b"ab", k=3 * n)), lambda: (rng.randbytes(30) * n)[: 3 * n]):
            p = webp.padded(make())
            assert webp.load(webp.store([p, p[:576]])) == [p, p[:576]]


def test_a_copy_from_outside_is_refused():
    p = webp.padded(b"abcdefgh" * 200)
    good = webp.store([p])[0]
    rng, refused = random.Random(2), 0
    for _ in range(200):
        bad = bytearray(good)
        bad[rng.randrange(20, len(bad))] ^= 1 << rng.randrange(8)
        try:
            webp.load([bytes(bad)])
        except (webp.BadImage, struct.error):
            refused += 1
    assert refused


class Encoder:
    """Writes streams with any feature, to test the decoder by; prefix codes are of equal length."""

    def __init__(self, width, height):
        self.w = webp.Writer()
        self.w.put(0x2F, 8)
        self.w.put(width - 1, 14)
        self.w.put(height - 1, 14)
        self.w.put(1, 4)

    def code(self, symbols, size):
        """A code for these symbols, a power of two of them, all of one length, by normal code lengths."""
        n = len(symbols).bit_length() - 1
        if n == 0:
            self.w.put(1, 1)
            self.w.put(0, 1)
            self.w.put(1, 1)
            self.w.put(symbols[0], 8)
            return {symbols[0]: (0, 0)}
        lengths = [n if s in set(symbols) else 0 for s in range(size)]
        own = [0] * 19
        own[0] = own[n] = 1
        self.w.put(0, 1)
        self.w.put(15, 4)
        for s in webp.CODE_LENGTH_ORDER:
            self.w.put(own[s], 3)
        self.w.put(0, 1)
        for x in lengths:
            self.w.put(int(x != 0), 1)
        return webp.canonical(lengths)[0]

    def image(self, px, top=False, cache=0, ops=None, meta=None):
        """px: rows of (a, r, g, b); ops: instead of literals, ('lit', p), ('copy', length, distance code) and ('cache', index)."""
        w = self.w
        w.put(int(cache > 0), 1)
        if cache:
            w.put(cache, 4)
        if top:
            w.put(int(meta is not None), 1)
            if meta:
                w.put(meta[0] - 2, 3)
                self.image(meta[1])
        more = 1 << cache if cache else 0
        for _ in range(meta[2] if meta else 1):
            green = self.code(list(range(512)) if ops else list(range(256)), 256 + 24 + more) if not ops or 256 + 24 + more >= 512 else self.code(list(range(256)), 280 + more)
            red, blue, alpha = (self.code(list(range(256)), 256) for _ in range(3))
            dist = self.code(list(range(32)), 40)
        for op in ops or [("lit", p) for p in px]:
            if op[0] == "lit":
                a, r, g, b = op[1]
                for c, v in ((green, g), (red, r), (blue, b), (alpha, a)):
                    w.put(*c[v])
            elif op[0] == "copy":
                w.put(*green[256 + op[1] - 1])  # lengths 1 to 4 have no further bits
                w.put(*dist[op[2] - 1])
            else:
                w.put(*green[280 + op[1]])

    def file(self):
        body = self.w.bytes()
        body += bytes(len(body) & 1)
        return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def _pixels(n, seed=0):
    rng = random.Random(seed)
    return [tuple(rng.randrange(256) for _ in range(4)) for _ in range(n)]


def _decoded(e):
    return [tuple(x) for x in webp.decode(e.file()).reshape(-1, 4)[:, [3, 0, 1, 2]].tolist()]


def test_literals_and_subtract_green():
    px = _pixels(35)
    e = Encoder(7, 5)
    e.w.put(1 | 2 << 1, 3)
    e.w.put(0, 1)
    e.image([(a, (r - g) & 255, g, (b - g) & 255) for a, r, g, b in px], top=True)
    assert _decoded(e) == px


def test_copies_and_colour_cache():
    px = _pixels(6)
    key = lambda p: (0x1E35A7BD * (p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]) & 0xFFFFFFFF) >> (32 - 8)
    e = Encoder(4, 5)
    e.w.put(0, 1)
    # Distance code 1 is the pixel above, 2 the one to the left.
    ops = [("lit", p) for p in px] + [("copy", 3, 1), ("cache", key(px[5])), ("copy", 4, 2), ("lit", px[0]), ("copy", 2, 1), ("copy", 3, 2)]
    e.image(None, top=True, cache=8, ops=ops)
    out = list(px)
    for op in ops[6:]:
        if op[0] == "lit":
            out.append(op[1])
        elif op[0] == "cache":
            out.append(px[5])
        else:
            for _ in range(op[1]):
                out.append(out[-4 if op[2] == 1 else -1])
    assert len(out) == 20 and _decoded(e) == out


def test_palette():
    rng = random.Random(3)
    colours = _pixels(3, 5)
    index = [rng.randrange(3) for _ in range(9 * 4)]
    e = Encoder(9, 4)
    e.w.put(1 | 3 << 1, 3)
    e.w.put(2, 8)
    deltas = [colours[0]] + [tuple((x - y) & 255 for x, y in zip(colours[i], colours[i - 1])) for i in (1, 2)]
    e.image(deltas)
    e.w.put(0, 1)
    packed = []
    for y in range(4):
        for x in range(0, 9, 4):
            packed.append((255, 0, sum(v << 2 * k for k, v in enumerate(index[9 * y + x : 9 * y + min(9, x + 4)])), 0))
    e.image(packed, top=True)
    assert _decoded(e) == [colours[i] for i in index]


def test_cross_colour():
    px, plan = _pixels(48, 7), _pixels(4, 8)
    s8 = lambda v: v - 256 if v > 127 else v
    stored = []
    for i, (a, r, g, b) in enumerate(px):
        y, x = divmod(i, 8)
        _, red_blue, green_blue, green_red = plan[(y >> 2) * 2 + (x >> 2)]
        d = lambda t, v: (s8(t) * s8(v)) >> 5
        stored.append((a, (r - d(green_red, g)) & 255, g, (b - d(green_blue, g) - d(red_blue, r)) & 255))
    e = Encoder(8, 6)
    e.w.put(1 | 1 << 1, 3)
    e.w.put(0, 3)
    e.image(plan)
    e.w.put(0, 1)
    e.image(stored, top=True)
    assert _decoded(e) == px


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    w, h = 6, 5
    px = _pixels(w * h, 20 + mode)
    half = lambda p, q: tuple((x + y) // 2 for x, y in zip(p, q))
    clip = lambda v: max(0, min(255, v))

    def guess(i):
        y, x = divmod(i, w)
        if i == 0:
            return (255, 0, 0, 0)
        if y == 0:
            return px[i - 1]
        if x == 0:
            return px[i - w]
        L, T, TL, TR = px[i - 1], px[i - w], px[i - w - 1], px[i - w + 1]
        near = [sum(abs(L[c] + T[c] - TL[c] - X[c]) for c in range(4)) for X in (L, T)]
        return [
            (255, 0, 0, 0), L, T, TR, TL, half(half(L, TR), T), half(L, TL), half(L, T), half(TL, T), half(T, TR), half(half(L, TL), half(T, TR)),
            L if near[0] < near[1] else T, tuple(clip(L[c] + T[c] - TL[c]) for c in range(4)), tuple(clip(m + int((m - TL[c]) / 2)) for c, m in enumerate(half(L, T))),
        ][mode]

    e = Encoder(w, h)
    e.w.put(1 | 0 << 1, 3)
    e.w.put(0, 3)
    e.image([(255, 0, mode, 0)] * 4)
    e.w.put(0, 1)
    e.image([tuple((a - b) & 255 for a, b in zip(p, guess(i))) for i, p in enumerate(px)], top=True)
    assert _decoded(e) == px


def test_meta_codes():
    px = _pixels(40, 9)
    e = Encoder(8, 5)
    e.w.put(0, 1)
    e.image(px, top=True, meta=(2, [(0, 0, 0, 0), (0, 0, 1, 0), (0, 0, 1, 0), (0, 0, 0, 0)], 2))
    assert _decoded(e) == px


def test_bad_images():
    good = webp.store([webp.padded(b"abc")])[0]
    for bad in (b"", b"RIFF", good[:30], good.replace(b"VP8L", b"VP8X")):
        with pytest.raises((webp.BadImage, struct.error)):
            webp.decode(bad)


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_file("word_bpe_49k.json")
    return Tokenizer.from_file(path), bpe.WordBPE(open(path, encoding="utf-8").read())


def test_bpe_query(spark, folder, rows, tokenizer):
    t = tokenizer[0]
    want = Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    found = QUERIES["op10_bpe"](spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=200), st.text("abcdehing's1! <|>endoftxé", max_size=300)))
def test_bpe_like_the_library(tokenizer, text):
    t, b = tokenizer
    assert np.frombuffer(b.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_words_stream(tokenizer):
    t, b = tokenizer
    rng = random.Random(6)
    for alphabet in ("ab", "aeiounrst", "thing"):
        text = "".join(rng.choice(alphabet) for _ in range(9000))
        assert np.frombuffer(b.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_small_windows_are_enough():
    """With the lookahead computed, streams give what plain merging gives, for merge lists of every kind."""
    rng = random.Random(8)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        while len(merges) < 9:
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if len(a + b) <= 7 and (a, b) not in merges:
                merges.append((a, b))
                vocab.setdefault(a + b, len(vocab))
        m = bpe.Merges(vocab, merges)
        m.window = m.lookahead + m.longest + 1
        ids = [rng.randrange(3) for _ in range(200)]
        stream, out, k = bpe.Stream(m), [], 0
        while k < len(ids):
            n = rng.randint(1, 40)
            out += stream.push(ids[k : k + n])
            assert len(stream.held) < m.window
            k += n
        assert out + stream.end() == m.merged(ids[:])


def test_merging_by_a_heap(tokenizer, monkeypatch):
    m, rng = tokenizer[1].merges, random.Random(2)
    symbols = [tokenizer[1].inner[ord(c)] for c in "abcdeinst"]
    for n in (1, 2, 5, 47, 48, 400):
        ids = [rng.choice(symbols) for _ in range(n)]
        monkeypatch.setattr(bpe, "HEAP_FROM", 1 << 30)
        want = m.merged(ids[:])
        monkeypatch.setattr(bpe, "HEAP_FROM", 0)
        assert m.merged(ids[:]) == want


def test_every_word_goes_through_the_transducer(tokenizer, monkeypatch):
    b, seen, push = bpe.WordBPE(open(bpe.tokenizer_file("word_bpe_49k.json"), encoding="utf-8").read()), [], bpe.Stream.push
    monkeypatch.setattr(bpe.Stream, "push", lambda self, s: (seen.append(len(s)), push(self, s))[1])
    b.encode("a bb ccc " + "d" * 3000 + " a bb")
    assert sorted(seen) == [1, 2, 3, 3000] and set(b.known) == {"a", "bb", "ccc"}


def test_pieces_leave_no_trace(tokenizer, monkeypatch):
    t, b = tokenizer
    monkeypatch.setattr(bpe, "PIECE", 40)
    rng = random.Random(7)
    parts = ["word ", "don't ", "we'll've ", "<|endoftext|>", "<|startoftext|> ", "a" * 70, "1" * 60, "=" * 90, "-'s" * 9, "é́ ", " ́x", "日本語" * 30, "각ᆨ", "\n\n", "x\t", "ΣΑΣ ", "İstanbul" * 8, "letters" * 9 + "'re", "<|endof" * 6, "🙂" * 30, "|>" * 20]
    cut = 0
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert "".join(p for p, _ in bpe.pieces(text)) == text
        cut += any(open_ for _, open_ in bpe.pieces(text))
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b.encode(text), "<u4").tolist() == want
        kept, n, ids, decoded = bpe.told(b, text, True)
        assert (n, ids) == (len(want), hashlib.sha256(kept).hexdigest()) and decoded == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert cut > 50


@pytest.mark.parametrize("text", ["some words here " * 100_000, "abcdefghij" * 40_000, "=" * 400_000], ids=["words", "letters", "signs"])
def test_memory_does_not_grow_with_the_text(tokenizer, text):
    import tracemalloc

    b = tokenizer[1]
    bpe.told(b, text[:100], False)
    tracemalloc.start()
    _, n, _, _ = bpe.told(b, text, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n and peak < 12 << 20  # a piece of 65,536 symbols, as Python's numbers


def test_decoder_takes_pieces(tokenizer):
    t, b = tokenizer
    ids = np.frombuffer(b.encode("Grüße 日本 <|endoftext|> it's"), "<u4")
    for joined in (True, False):
        one, many = bpe.Decoder(b, joined), bpe.Decoder(b, joined)
        whole = one.feed(ids) + one.end()
        assert "".join([many.feed(ids[k : k + 1]) for k in range(len(ids))]) + many.end() == whole
    assert whole == "grüße 日本 <|endoftext|>it 's "


def test_encode_and_decode_columns(spark, folder):
    docs = base.table(spark, folder, "documents")
    path = bpe.tokenizer_file("word_bpe_49k.json")
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.count() == docs.count()


# Fingerprints


def lanes(text):
    total = [0] * fingerprint.LANES
    for p in text.split("\n") if text else []:
        d = hashlib.sha256(p.encode()).hexdigest().encode()
        wide = "".join(hashlib.sha256(d + f"-{g}".encode()).hexdigest() for g in range(fingerprint.LANES // 16))
        for k in range(fingerprint.LANES):
            v = int(wide[4 * k : 4 * k + 4], 16)
            total[k] += v - 65536 if v > 32767 else v
    return [x % (1 << 32) for x in total]


def test_fingerprint_query(spark, folder, rows):
    found = QUERIES["op4_fingerprint"](spark, folder).collect()
    tie = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), seed=42)))[0]
    ordered = sorted(((i is not None, i or 0, tie(t or ""), t or "") for i, t in rows))
    want = Counter()
    hexed = lambda v: "".join(f"{x:08x}" for x in v)
    for k, (known, i, _, t) in enumerate(ordered):
        n, nxt = len(t), ordered[(k + 1) % len(ordered)][3]
        e = t[: n - n // 2] + nxt[: n // 2]
        want[i if known else None, n, hashlib.sha256(e.encode()).hexdigest(), hexed(lanes(t)), hexed(lanes(e))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in found) == want
    assert all(0 <= r[c] <= 1 for r in found for c in ("near_edited", "near_next"))
    assert all(r["near_edited"] == 1 for r in found if r["fingerprint"] == r["edited_fingerprint"])


def _fingerprints(spark, path, rows):
    from .conftest import write

    write(spark, path, "documents", rows, "doc_id bigint, text string")
    found = QUERIES["op4_fingerprint"](spark, path).collect()
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found)


@pytest.mark.parametrize(
    "ids",
    [[0], [-(1 << 63), -(1 << 63) + 1, -1, 0, (1 << 63) - 2, (1 << 63) - 1], [*range(400), 1 << 60], [3 * i for i in range(50)], [5] * 40 + [6], []],
    ids=["one", "extreme", "sparse", "even", "repeated", "none"],
)
def test_the_next_document(spark, tmp_path, ids):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abé🙂 \n") for _ in range(rng.randrange(30)))) for i in ids]
    if len(set(ids)) < len(ids):
        rows = [(5, "same\ntext")] * 40 + [(6, "another")]
    ordered = sorted(rows, key=lambda r: r[0])
    want = []
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        want.append((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()))
    rng.shuffle(rows)
    assert _fingerprints(spark, str(tmp_path), rows) == Counter(want)


def test_null_ids_are_spread(spark, tmp_path):
    rows = [(None, f"{i:03d}{i:03d}") for i in range(300)] + [(1, "a"), (2, "b")]
    found = _fingerprints(spark, str(tmp_path), rows)
    assert sum(found.values()) == 302 and len({k[2] for k in found}) > 250


def test_fingerprints_by_sql(spark, tmp_path):
    from .conftest import write

    rng = random.Random(6)
    rows = [(i, rng.choice([None, "", "\n", "a\nb\na", "é\n🙂 x", "line\n" * rng.randrange(9)]) if i % 3 else f"only {i}") for i in range(60)]
    write(spark, str(tmp_path), "documents", rows, "doc_id bigint, text string")
    found = QUERIES["op4_fingerprint"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLES["op4_fingerprint"])
    assert Counter(tuple(r) for r in found.select(*want.columns).collect()) == Counter(want.fetchall())


def test_fingerprints_are_homomorphic(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\nb", "c", "b\nc\na\nb")], "x string, y string, z string")
    f = lambda c: fingerprint.fingerprint(F.col(c))
    r = df.select(fingerprint.combine(f("x"), f("y")).alias("xy"), f("z").alias("z"), fingerprint.remove(f("z"), f("y")).alias("zy"), f("x").alias("x")).first()
    assert r["xy"] == r["z"] and r["zy"] == r["x"]


# WARC


def test_warc_query(spark, folder):
    pages = base.table(spark, folder, "pages").collect()
    found = QUERIES["op8_warc"](spark, folder).collect()
    first = {}
    for p in pages:
        h = p["html"] or ""
        if len(h.encode()) >= 100 and p["page_id"] is not None:
            first[h] = min(first.get(h, 1 << 60), p["page_id"])
    want = Counter()
    for p in pages:
        h = p["html"] or ""
        revisit = h in first and first[h] != p["page_id"]
        want[p["page_id"], len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None] += 1
    assert Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in found) == want


def test_url_keys(spark):
    urls = ["https://Blog.Example.com:443/a/b?q=1#x", "http://user:pw@x.org", "ftp://1.2.3.4/p", "not a url", "", None, "http://h?x#y"]
    from pyspark.sql import functions as F

    found = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert found == ["com,example,blog)/a/b?q=1", "org,x)", "4,3,2,1)/p", "not a url", "", "", "h)?x"]


def test_index_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    folder = f"file://{tmp_path}/w"
    rows = [(f"com,h{i % 5})/{i % 7}", i if i else None, f"d{i % 3}", "f", i * 10, 10) for i in range(60)]
    shards = warc.write_index(spark.createDataFrame(rows, warc.CDX), folder)
    index = warc.Index(folder, shards)
    for k, i, d, *rest in rows:
        assert index.find(k, i, d)[3:] == rest
    for k, i, d in (("aaa", 1, "d1"), ("com,h1)/1", 10**9, "d1"), ("zzz", 1, "d1"), (*rows[7][:2], "other"), (rows[0][0], warc.NONE, "d0")):
        with pytest.raises(warc.NotIndexed):
            index.find(k, i, d)


def _archived(spark, path, rows):
    from .conftest import write

    write(spark, path, "pages", rows, "page_id bigint, url string, html string")
    found = QUERIES["op8_warc"](spark, path).collect()
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found)


def test_rows_of_one_url_and_page_are_read_back_each(spark, tmp_path):
    html = ["a" * 120, "b" * 130, None, "c" * 140]
    rows = [(1, "http://x.org/", html[0]), (1, "http://x.org/", html[1]), (1, "http://x.org/", html[2]), (2, "http://x.org/", html[1]), (None, None, html[3]), (None, None, html[0]), (None, None, html[3])]
    sha = [hashlib.sha256((h or "").encode()).hexdigest() for h in html]
    want = [(1, 120, sha[0], "response", None), (1, 130, sha[1], "response", None), (1, 0, sha[2], "response", None), (2, 130, sha[1], "revisit", 1), (None, 140, sha[3], "response", None), (None, 120, sha[0], "revisit", 1), (None, 140, sha[3], "response", None)]
    assert _archived(spark, str(tmp_path), rows) == Counter(want)


def test_urls_with_line_breaks(spark, tmp_path):
    html = "é" * 90
    rows = [(5, "http://x.org/a\r\nb: c\n\n", html), (9, "http://\n", html), (7, "HTTP://İΣ.org/ \r", html), (-(1 << 63), "\n", "short")]
    sha = hashlib.sha256(html.encode()).hexdigest()
    want = [(5, 180, sha, "response", None), (9, 180, sha, "revisit", 5), (7, 180, sha, "revisit", 5), (-(1 << 63), 5, hashlib.sha256(b"short").hexdigest(), "response", None)]
    assert _archived(spark, str(tmp_path), rows) == Counter(want)


def test_empty_pages(spark, empty):
    for name in ("op4_fingerprint", "op5_mixing", "op6_webp", "op8_warc", "op10_bpe"):
        assert QUERIES[name](spark, empty).count() == 0


# Mixing


def _duck(folder):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return c


def test_mixing_by_sql(spark, folder):
    found = QUERIES["op5_mixing"](spark, folder).collect()
    want = _duck(folder).sql(ORACLES["op5_mixing"]).fetchall()
    key = lambda r: (r[0], r[1], round(r[2], 9), *r[3:])
    assert Counter(key(r) for r in found) == Counter(key(r) for r in want)
    assert any(r["n_chars"] for r in found) and len({r["copy"] for r in found}) > 1


def test_the_mix_is_in_one_order(spark, folder):
    out = mixing.mix(base.table(spark, folder, "documents").drop("rate", "copy"))
    keys = [r["shuffle_key"] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys) and out.rdd.getNumPartitions() > 1


def test_a_null_source_has_the_weight_of_none(spark):
    docs = spark.createDataFrame([(i, "x" * 9, s) for i in range(300) for s in (None, "", "a")], "doc_id bigint, text string, source string")
    rate = lambda w: {r["source"]: round(r["rate"], 3) for r in mixing.rates(docs, w).collect()}
    assert rate({"a": 1.0}) == {None: 0, "": 0, "a": 3} and rate({None: 1.0, "": 3.0}) == {None: 0.75, "": 2.25, "a": 0}


def test_mixing_meets_weights(spark):
    rows = [(i, "x" * (5 + i % 9), "big" if i % 10 else "small") for i in range(6000)] + [(None, "y", None), (7000, None, "void"), (7001, "z", "free")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, {"big": 1.0, "small": 3.0})
    got = {r[0]: r[1] for r in out.selectExpr("source", "length(text) n").groupBy("source").sum("n").collect()}
    assert set(got) == {"big", "small"} and abs(got["small"] / got["big"] - 3) < 0.3
    assert out.columns == ["doc_id", "text", "source", "rate", "copy", "shuffle_key"]


def test_large_rates_are_poisson(spark):
    rows = [(i, "x", "a") for i in range(400)] + [(1000 + i, "x" * 400, "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    n = [r[1] for r in mixing.mix(docs, {"a": 1.0}, size=0.1).groupBy("doc_id").count().collect()]
    assert abs(np.mean(n) - 40.1) < 2 and abs(np.var(n) / np.mean(n) - 1) < 0.3


def test_without_weights_all_rates_are_zero(spark, folder):
    docs = base.table(spark, folder, "documents").drop("rate", "copy")
    assert mixing.mix(docs, {}).count() == 0
