"""WARC archives with a two-level capture index.

Records are gzip members of their own in archive files of at most ARCHIVE_BYTES. Captures are sorted by reversed-host
URL key; every BLOCK of them are a compressed block of an index shard, and the shard's directory has each
block's first key and place. A lookup finds the shard and the block by binary search, reads that block alone, finds
the capture in it by binary search, and reads the record's bytes alone from its archive.

Files are written to the folder given, which all machines share, under names of their own: what a lost or repeated
task leaves is referred to by nothing.

A capture is known by its key, page_id and payload digest, so rows that repeat a url and page_id are each read back as they were
written. A revisit's record names its response's key as it stands in the index; no key is made of a url that was read.

Defined results: null html is the empty payload, a null url the empty key; line breaks in urls are written as %0D and %0A; payloads under
REVISIT_BYTES are always responses; rows that repeat a response's page_id and payload are responses too; of rows of one
payload, a null page_id counts as the largest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, remove, sub_batches, table

REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
BLOCK = 512
#: Blocks, open files and payload digests that a task remembers.
BLOCKS_KEPT, FILES_KEPT, DIGESTS_KEPT = 16, 64, 4096
NONE = -(1 << 63)
#: Archived bytes that a task reads back, where the session's partitions would leave more to each.
READ_BYTES = 256 << 20
CDX = "key string, page_id bigint, digest string, file string, at bigint, size bigint"
#: Schemes that pyarrow has under another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


class NotIndexed(LookupError):
    """The index has no such capture."""


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = folder.partition(":")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def one_line(url: Column) -> Column:
    return F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def url_key(url: Column) -> Column:
    """Host labels reversed, then ')' and what follows the host, without scheme, user, port and fragment."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rest = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, refers_key: str | None) -> bytes:
    """A record as a gzip member. A revisit has the payload's size and digest in its head, but not the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Refers-To-Key: {refers_key}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's head, its HTTP head and what follows that."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, http, body


def _id(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url (on one line), its key, html, payload digest, and refers_to, refers_url and refers_key where another page of the same
    payload is the response.

    Only digests that occur twice go to the join, which may split a hot digest; counts are combined before the shuffle."""
    p = pages.select("page_id", one_line(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    long = p.where(F.octet_length("html") >= REVISIT_BYTES)
    order = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)), F.col("url"))
    firsts = long.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    firsts = firsts.where("n > 1").select(F.col("digest").alias("d"), F.col("o.col1").alias("first_id"), F.col("o.url").alias("first_url"))
    joined = p.join(firsts, (F.col("digest") == F.col("d")) & (F.octet_length("html") >= REVISIT_BYTES), "left")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("first_id") != (1 << 63) - 1)
    refers = [F.when(other, F.col("first_id")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_url"), F.when(other, url_key(F.col("first_url"))).alias("refers_key")]
    return joined.select("page_id", "url", url_key(F.col("url")).alias("key"), "html", "digest", *refers)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of with_revisits; gives the captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(base)
        out, name, at = None, "", 0
        try:
            for batch in (part for whole in batches for part in sub_batches(whole, "html")):
                names, ats, sizes = [], [], []
                cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
                for i in range(batch.num_rows):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    r = record(cols["page_id"][i], cols["url"][i], cols["html"][i].encode(), cols["digest"][i], cols["refers_to"][i], cols["refers_url"][i], cols["refers_key"][i])
                    out.write(r)
                    names.append(name)
                    ats.append(at)
                    sizes.append(len(r))
                    at += len(r)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page_id"), batch.column("digest"), pa.array(names, pa.string()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "page_id", "digest", "file", "at", "size"])
        finally:
            if out:
                out.close()

    return rows.mapInArrow(run, CDX)


def capture_key(key: str, page_id: int | None, digest: str) -> tuple[str, int, str]:
    """What a capture is sorted and looked up by; a missing page_id is not that of the least number."""
    return (key, NONE, f"~{digest}") if page_id is None else (key, page_id, digest)


def _by() -> list[Column]:
    null = F.col("page_id").isNull()
    return [F.col("key"), F.coalesce("page_id", F.lit(NONE)), F.when(null, F.concat(F.lit("~"), F.col("digest"))).otherwise(F.col("digest"))]


def _sorted(rows: DataFrame, archived: int) -> DataFrame:
    """By capture keys, in as many tasks as the archived bytes ask for: rows are thin, but what they stand for is not."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), archived // READ_BYTES)
    return rows.repartitionByRange(n, *_by()).sortWithinPartitions(*_by())


def write_index(captures: DataFrame, folder: str) -> list[tuple]:
    """Sorts captures into index shards; gives (first capture key, shard) of each, in order: one per partition. Equal url keys may be
    in several shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(base)
        name, directory, at, held, out = uuid.uuid4().hex, [], 0, [], None

        def flush() -> None:
            nonlocal at, held
            z = zlib.compress(json.dumps(held, separators=(",", ":")).encode(), 4)
            out.write(z)
            directory.append((*held[0][:3], at, len(z)))
            at, held = at + len(z), []

        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    out = out or files.open_output_stream(f"{base}/{name}.index", compression=None)
                    held.append((*capture_key(*row[:3]), *row[3:]))
                    if len(held) == BLOCK:
                        flush()
            if held:
                flush()
        finally:
            if out:
                out.close()
        if directory:
            with files.open_output_stream(f"{base}/{name}.directory", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*directory[0][:3], name)], names=["k", "i", "d", "shard"])

    found = _sorted(captures, captured_bytes(captures)).mapInArrow(run, "k string, i bigint, d string, shard string")
    return sorted(tuple(r) for r in found.collect())


def captured_bytes(captures: DataFrame) -> int:
    return captures.agg(F.sum("size")).first()[0] or 0


class Index:
    """Looks captures up. Directories, blocks and archives are read when first needed."""

    def __init__(self, folder: str, shards: list[tuple]):
        self.files, self.base = file_system(folder)
        self.shards, self.first = shards, [tuple(s[:3]) for s in shards]
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()
        self.open: OrderedDict = OrderedDict()

    @staticmethod
    def _held(kept: OrderedDict, key, make, most: int):
        if key in kept:
            kept.move_to_end(key)
        else:
            kept[key] = make()
            if len(kept) > most:
                gone = kept.popitem(last=False)[1]
                if hasattr(gone, "close"):
                    gone.close()
        return kept[key]

    def bytes(self, name: str, at: int, size: int) -> bytes:
        f = self._held(self.open, name, lambda: self.files.open_input_file(f"{self.base}/{name}"), FILES_KEPT)
        f.seek(at)
        return f.read(size)

    def _directory(self, shard: str) -> list:
        with self.files.open_input_stream(f"{self.base}/{shard}.directory", compression=None) as f:
            return [((k, i, d), at, size) for k, i, d, at, size in json.loads(zlib.decompress(f.read()))]

    def find(self, key: str, page_id: int | None, digest: str) -> list:
        """The capture of this key, page and payload."""
        want = capture_key(key, page_id, digest)
        s = bisect_right(self.first, want) - 1
        if s >= 0:
            shard = self.shards[s][3]
            directory = self._held(self.directories, shard, lambda: self._directory(shard), 4)
            b = bisect_right(directory, want, key=lambda d: d[0]) - 1
            if b >= 0:
                _, at, size = directory[b]
                block = self._held(self.blocks, (shard, b), lambda: json.loads(zlib.decompress(self.bytes(f"{shard}.index", at, size))), BLOCKS_KEPT)
                i = bisect_left(block, [*want])
                if i < len(block) and tuple(block[i][:3]) == want:
                    return block[i]
        raise NotIndexed(f"no capture of page {page_id} with key {key!r} and digest {digest}")

    def read(self, capture: list) -> tuple[dict[str, str], bytes, bytes]:
        return parse(self.bytes(*capture[3:6]))


def read_archives(queries: DataFrame, folder: str, shards: list[tuple], archived: int) -> DataFrame:
    """Looks up every row of key, page_id and digest and reads its record; a revisit's payload is that of its response, found
    through the index too. Payloads are checked against the record's digest. shards: a row per index partition."""
    held = queries.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = Index(folder, held.value), OrderedDict()
        for batch in batches:
            rows = []
            for key, page_id, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "digest"))):
                fields, _, body = index.read(index.find(key, page_id, wanted))
                refers = None
                if fields["WARC-Type"] == "revisit":
                    refers, stated = _id(fields["WARC-Refers-To"]), fields["WARC-Payload-Digest"]
                    if stated not in known:
                        body = index.read(index.find(fields["WARC-Refers-To-Key"], refers, wanted))[2]
                        known[stated] = len(body), hashlib.sha256(body).hexdigest()
                        if len(known) > DIGESTS_KEPT:
                            known.popitem(last=False)
                    size, digest = known[stated]
                else:
                    size, digest = len(body), hashlib.sha256(body).hexdigest()
                if not wanted == digest == fields["WARC-Payload-Digest"].removeprefix("sha256:"):
                    raise ValueError(f"page {page_id}: the payload read back is not what was written")
                rows.append((page_id, size, digest, fields["WARC-Type"], refers))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _sorted(queries.select("key", "page_id", "digest"), archived).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, indexes the captures, then reads each page back through the index."""
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.root}/archives"
    captures = scratch.keep(write_archives(with_revisits(table(spark, sf_dir, "pages")), folder), "captures")
    shards = write_index(captures, folder)
    out = scratch.keep(read_archives(captures, folder, shards, captured_bytes(captures)), "read")
    remove(spark, folder)
    scratch.drop(captures)
    return out


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE octet_length(encode(html)) >= {REVISIT_BYTES} GROUP BY digest)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id OR octet_length(encode(p.html)) < {REVISIT_BYTES} THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id OR octet_length(encode(p.html)) < {REVISIT_BYTES} THEN NULL ELSE f.first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
