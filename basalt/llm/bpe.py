"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

`Merges.lookahead` is computed from the merge list: whether a merge is applied at a place depends on at most
so many symbols to its right. So a token that ends that far before the end of what has been read is stable and
is emitted; the transducer (`Stream`) holds `Merges.window` symbols of a word besides those it was just given, whatever the word's
length. All words go through it; one that ends within the lookahead is stable at its end. `Encoder` feeds it a text in pieces of
PIECE characters, also where a word is longer than that, so what is held besides a text does not grow with it. Words that come again
are looked up in a cache of bounded bytes. Decoding is a state machine too: `Decoder` takes ids in pieces and holds back only an unfinished
UTF-8 sequence.

Texts are cut where it leaves no trace: behind a blank before an ASCII character, or within a run of RUN letters, digits or signs, in
which no special token and no contraction can lie, and where nothing composes across the cut. Only a text without any such place is
taken whole.

Defined results: null and empty texts give no ids and the empty text; equal texts give equal ids; strings of
special tokens in a text become their ids, as the tokenizers library does by default. Code points that no Unicode version up to
16 assigns may count as letters here and not there, or the other way round.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .base import free, schema_of, sub_batches, table

#: Bytes of words and tokens that a worker remembers, and of the longest such word; only speed depends on it.
REMEMBERED, LONGEST_REMEMBERED = 32 << 20, 64
#: Characters that go to the transducer at once, about.
PIECE = 1 << 16
#: Longer than any run of letters in a special token.
RUN = 18
#: Symbols from which on merges are found by a heap.
HEAP_FROM = 48
#: White space by Unicode's property, as the tokenizer files' \\s means it.
SPACE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(odd)) for b in range(256)]


class Merges:
    """A merge list over symbols: ranks of pairs, the lookahead it needs, and the transducer."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        #: Pair of ids to rank and id of what they become, in one number each.
        self.pair: dict[int, int] = {}
        for i, (a, b) in enumerate(merges):
            self.pair.setdefault(vocab[a] << 20 | vocab[b], i << 20 | vocab[a + b])
        self.sizes = [0] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.sizes[i] = self._size(t)
        self.lookahead, self.longest = self._reach(merges)
        self.window = 2 * (self.lookahead + self.longest)

    def _size(self, symbol: str) -> int:
        return len(symbol) - len(self.end) if self.end and symbol.endswith(self.end) and len(symbol) > len(self.end) else len(symbol)

    def _reach(self, merges: list[tuple[str, str]]) -> tuple[int, int]:
        """A merge (u, v) can be kept from happening only by an earlier merge whose left part is v or a right part
        of v's own making, and that one by yet earlier ones further right. In order of rank, the farthest such
        chain from each left part is known when it is needed."""
        spine: dict[str, tuple[str, ...]] = {}
        far: dict[str, int] = {}
        most = longest = 1
        for u, v in merges:
            parts = spine.get(v, (v,))
            reach = max(far.get(x, 0) for x in parts)
            made = u + v
            spine.setdefault(made, (made, *parts))
            longest = max(longest, self._size(made))
            far[u] = max(far.get(u, 0), self._size(v) + reach)
            most = max(most, far[u])
        return most, longest

    def merged(self, ids: list[int]) -> list[int]:
        """Plain BPE of a bounded list of symbols: the merge of lowest rank first, leftmost first."""
        if len(ids) >= HEAP_FROM:
            return self._merged_long(ids)
        get, none = self.pair.get, 1 << 60
        ranks = [get(p, none) for p in map(_pair, ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i] = made = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(made << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | made, none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        get, n = self.pair.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i, p in enumerate(map(_pair, ids, ids[1:])) if (r := get(p)) is not None]
        heapify(heap)
        while heap:
            best, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 20 | ids[j]) != best:
                continue  # one of the two is gone
            ids[i], ids[j] = best & 0xFFFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(ids[i] << 20 | ids[k])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 20 | ids[i])) is not None:
                heappush(heap, (r, h))
        return [x for x in ids if x >= 0]


class Stream:
    """A word's symbols in, its tokens out, each as soon as it is stable."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, []

    def push(self, symbols: list[int]) -> list[int]:
        m, held, at, out = self.merges, self.held + symbols, 0, []
        while len(held) - at >= m.window:
            part = held[at : at + m.window]
            stable, done = len(part) - m.lookahead, 0
            for token in m.merged(part):
                if done + m.sizes[token] > stable:
                    break
                done += m.sizes[token]
                out.append(token)
            at += done
        self.held = held[at:]
        return out

    def end(self) -> list[int]:
        held, self.held = self.held, []
        return self.merges.merged(held)


def _pair(a: int, b: int) -> int:
    return a << 20 | b


class WordBPE:
    """Encoder and decoder of a tokenizer file with word ends, lower case and white space dropped."""

    def __init__(self, text: str):
        j = json.loads(text)
        m = j["model"]
        self.merges = Merges(m["vocab"], [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in m["merges"]], m["end_of_word_suffix"])
        special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        pattern = next(x for x in j["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"].replace(r"\s", SPACE)
        self.words = regex.compile(pattern).findall
        # The same pattern where only ASCII occurs; lower case already.
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        self.letters = byte_letters()
        self.inner = [m["vocab"][c] for c in self.letters]
        self.last = [m["vocab"][c + m["end_of_word_suffix"]] for c in self.letters]
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        names = dict(m["vocab"]) | special
        self.names = [""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.names[i] = t
        back = {c: b for b, c in enumerate(self.letters)}
        end = m["end_of_word_suffix"]
        self.bytes = [t.encode() if t in special else bytes(back[c] for c in t.removesuffix(end)) + b" " * t.endswith(end) for t in self.names]

    def word(self, w: str) -> bytes:
        """A word's ids as little-endian unsigned 32-bit integers."""
        raw, stream = w.encode(), Stream(self.merges)
        ids = stream.push([self.inner[x] for x in raw[:-1]] + [self.last[raw[-1]]])
        out = array("I", ids + stream.end()).tobytes()
        if len(raw) <= LONGEST_REMEMBERED:
            self.known_bytes += len(raw) + len(out)
            if self.known_bytes > REMEMBERED:
                self.known.clear()
                self.known_bytes = len(raw) + len(out)
            self.known[w] = out
        return out

    def split(self, text: str) -> list[str | int]:
        """The words of a piece of text, and ids of special tokens."""
        if "<" in text and len(parts := self.cut.split(text)) > 1:
            return [x for p in parts for x in ((self.special[p],) if p in self.special else self.split(p))]
        if text.isascii():
            return self.ascii_words(text.lower())
        # Lower case letter by letter: a capital sigma at a word's end has no form of its own.
        return self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> bytes:
        encoder = Encoder(self)
        return b"".join(encoder.feed(p, open_) for p, open_ in pieces(text))


#: Where a text may be cut: behind a blank, or before the last character of a run. The last kind is of letters that compose
#: with nothing before them.
CUT = re.compile(rf"[ \t\n\r](?=[!-~])|[A-Za-z]{{{RUN}}}|[0-9]{{{RUN}}}|[!-&(-/:;=?@\[-`{{}}~]{{{RUN}}}|[\u3041-\u3096\u4e00-\u9fff\uac00-\ud7a3]{{{RUN}}}")


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Pieces of a text, and whether each one's last word goes on in the next."""
    at = 0
    while len(text) - at > PIECE and (m := CUT.search(text, at + PIECE - RUN)):
        blank = m.end() == m.start() + 1
        end = m.end() if blank else m.end() - 1
        yield text[at:end], not blank and text[end] not in "0123456789"
        at = end
    yield text[at:], False


class Encoder:
    """A text in pieces to ids in pieces. Between two of them it holds the stream of a word that goes on, and the word's last byte
    so far, as a word's last symbol is another one."""

    def __init__(self, bpe: WordBPE):
        self.bpe, self.stream, self.byte = bpe, None, 0

    def _more(self, w: str) -> list[int]:
        raw = w.encode() if self.stream is None else bytes([self.byte]) + w.encode()
        self.stream = self.stream or Stream(self.bpe.merges)
        self.byte = raw[-1]
        return self.stream.push([self.bpe.inner[x] for x in raw[:-1]])

    def feed(self, piece: str, open_: bool = False) -> bytes:
        words, out = self.bpe.split(piece), []
        if self.stream is not None and words:
            ids = self._more(words.pop(0))
            if words or not open_:
                ids += self.stream.push([self.bpe.last[self.byte]]) + self.stream.end()
                self.stream = None
            out.append(array("I", ids).tobytes())
        last = words.pop() if open_ and words else None
        known, word = self.bpe.known.get, self.bpe.word
        out += [x.to_bytes(4, "little") if isinstance(x, int) else known(x) or word(x) for x in words] if "<" in piece else [known(w) or word(w) for w in words]
        if last is not None:
            out.append(array("I", self._more(last)).tobytes())
        return b"".join(out)


class Decoder:
    """Ids in pieces to text in pieces.

    joined: what the tokenizers library's decode gives for a file without a decoder, the tokens' names with one
    space between; its state is whether anything came before. Otherwise the tokens' bytes, a space after each
    word's end; its state is an unfinished UTF-8 sequence.
    """

    def __init__(self, bpe: WordBPE, joined: bool = True):
        self.bpe, self.joined, self.begun = bpe, joined, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        if not self.joined:
            return self.utf8.decode(b"".join(map(self.bpe.bytes.__getitem__, ids.tolist())))
        out = " ".join(map(self.bpe.names.__getitem__, ids.tolist()))
        out = f" {out}" if self.begun and len(ids) else out
        self.begun |= bool(len(ids))
        return out

    def end(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", True)


_loaded: dict[str, WordBPE] = {}


def _bpe(text: str) -> WordBPE:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBPE(text)
    return _loaded[key]


def told(bpe: WordBPE, text: str, keep: bool) -> tuple[bytes | None, int, str, str]:
    """The ids, where they are to be kept, their number and digest, and the digest of what they decode to, a piece at a time."""
    encoder, decoder, ids, decoded, n, kept = Encoder(bpe), Decoder(bpe), hashlib.sha256(), hashlib.sha256(), 0, []
    for p, open_ in pieces(text):
        x = encoder.feed(p, open_)
        ids.update(x)
        n += len(x) // 4
        decoded.update(decoder.feed(np.frombuffer(x, "<u4")).encode())
        if keep:
            kept.append(x)
    decoded.update(decoder.end().encode())
    return b"".join(kept) if keep else None, n, ids.hexdigest(), decoded.hexdigest()


def encode(df: DataFrame, tokenizer_path: str, column: str = "text", to: str = "ids", digest: bool = False, both: bool = False) -> DataFrame:
    """Replaces a text column by its ids, binary of little-endian unsigned 32-bit integers; with digest by n_tokens,
    ids_sha256 and decoded_sha256, the ids decoded again; with both by all of these. They have __ before their names where there are such
    columns already. The tokenizer file, a few MB, is broadcast."""
    made = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} if digest or both else {}
    made = {to: "binary"} | made if both or not digest else made
    made = dict(zip(free(list(made), [c for c in df.columns if c != column]), made.values()))
    with open(tokenizer_path, encoding="utf-8") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(held.value)
        for batch in batches:
            for part in sub_batches(batch, column):
                texts = (t.as_py() or "" for t in part.column(column))
                if digest or both:
                    cols = zip(*(told(bpe, t, both) for t in texts))
                    new = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.string()))][not both :]
                else:
                    new = [pa.array([bpe.encode(t) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], names=[*keep, *made])

    return df.mapInArrow(run, ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` {t}" for c, t in made.items()]))


def decode(df: DataFrame, tokenizer_path: str, column: str = "ids", to: str = "decoded", joined: bool = True) -> DataFrame:
    """Adds the text of a column of ids, with __ before its name where there is such a column; null ids are none."""
    (to,) = free([to], df.columns)
    with open(tokenizer_path, encoding="utf-8") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(held.value)
        for batch in batches:
            out = []
            for x in batch.column(column).to_pylist():
                d, ids = Decoder(bpe, joined), np.frombuffer(x or b"", "<u4")
                out.append("".join([d.feed(ids[i : i + PIECE]) for i in range(0, len(ids), PIECE)]) + d.end())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, to])

    return df.mapInArrow(run, schema_of(df, f"`{to}` string"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, tokenizer_path or tokenizer_file("word_bpe_49k.json"), digest=True)
