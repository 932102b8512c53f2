"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record into files of the shared folder; payloads
that repeat are written once and revisited.  ``build_index`` sorts the captures by reversed-host
URL key and packs runs of index lines into compressed blocks; every index file ends with its sparse
block directory, and the table of index files (one row a file, so one a task that wrote) names the
keys that each spans.  A key is answered by binary search over that table, over the directory of the
file and over the lines of the block, and then a range read of the record.  ``lookup`` does so for
one url; ``find`` does so for a table of keys: a key's blocks are looked up first and dealt over
tasks, so a url with a large share of all captures is answered by many.  ``read_captures`` reads a
whole archive set block by block.

Files are written and read with ``pyarrow.fs``, by the URI of the shared folder, under a name
of their own for every task attempt; only names that a finished attempt returned are used, so a
retried or speculative task leaves no half-written record behind.

Defined cases: null html is an empty payload; payloads below ``min_bytes`` are never revisits;
null urls have no target and sort first; control characters and blanks in urls are
percent-encoded; rows that repeat a page id and payload are all written, and those with the
smallest page id of their payload are responses; null page ids are written, never referred to;
an empty table writes no archive; keys that no record has are answered by no row; a page of any
size is one record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

MANIFEST = "url_key string, page_id long, record_type string, archive string, byte_offset long, byte_length long"
FILES = "first_key string, last_key string, index_file string, page_offset long, page_length long, n_blocks long, n_lines long"
DIRECTORY = "first_key string, last_key string, index_file string, byte_offset long, byte_length long, n_lines long"
CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
ARCHIVE_BYTES = 32 << 20
BLOCK_LINES = 1000
HOT, SALTS = 1000, 32


def url_key(url: str | None) -> str:
    """Reversed host, port if unusual, then path and query, as in ``com,example,www)/a?b``."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return "-)" + quote(url, safe="/?&=%#:;,+~!*'()@$[]")
    host = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    if port and port not in (80, 443):
        host += f":{port}"
    tail = (parts.path or "/") + (f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else "")
    return quote(f"{host}){tail}", safe="/?&=%:;,+~!*'()@$[]")


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _join(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed.  A revisit holds the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; ``payload`` is None for a revisit."""
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = raw[cut + 4 : cut + 4 + int(named["content-length"])]
    if len(body) != int(named["content-length"]) or raw[cut + 4 + len(body) :] != b"\r\n\r\n":
        raise ValueError("record length doesn't match its bytes")
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    number = lambda x: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", x or "")) else None
    kind = named["warc-type"]
    return {
        "page_id": number(named["warc-record-id"]),
        "url": unquote(named["warc-target-uri"]) if "warc-target-uri" in named else None,
        "record_type": kind,
        "refers_to": number(named.get("warc-refers-to")),
        "payload_digest": named["warc-payload-digest"].removeprefix("sha256:"),
        "payload_bytes": size,
        "payload": None if kind == "revisit" else payload,
    }


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member; an archive is readable without its index."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(data[at:]) + z.flush()
        size = len(data) - at - len(z.unused_data)
        yield at, size, raw
        at += size


def _revisits(pages: DataFrame, scratch: Scratch, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """Pages with their payload, its digest and the page they revisit, if any."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url"), payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = scratch.table(first.filter("n > 1 and first_id is not null"), "repeated")
    # payloads that make up more than one in HOT of the repeated pages, fewer than HOT of them, are salted
    total = first.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(first.filter(F.col("n") * HOT > total).select(F.col("digest").alias("_often")))
    rows = rows.join(often, F.col("digest") == F.col("_often"), "left")
    rows = rows.withColumn("salt", F.when(F.col("_often").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(0).cast("int"))
    first = first.withColumn("salt", F.explode(F.when(F.col("n") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    return rows.join(first, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", to.alias("refers_to"))


def write_archives(pages: DataFrame, scratch: Scratch, root: str, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 100, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Write all pages below ``root``; the result, evaluated once, is the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _fs(root)
        files.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(_join(base, name), compression=None)
                    data = _gzip(record(page_id, url, payload, digest, to, date))
                    out.write(data)
                    rows.append((url_key(url), page_id, "response" if to is None else "revisit", _join(root, name), at, len(data)))
                    at += len(data)
                yield _batch(rows, MANIFEST)
        finally:
            if out is not None:
                out.close()

    return _revisits(pages, scratch, id_col, html_col, min_bytes).mapInArrow(run, MANIFEST)


_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def build_index(manifest: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write sorted, compressed index files below ``root``; the result is the table of files.

    A file is compressed blocks of lines and, last, the compressed directory of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _fs(root)
        files.create_dir(base, recursive=True)
        name, out, at, lines, blocks = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def flush() -> None:
            nonlocal out, at, lines
            if out is None:
                out = files.open_output_stream(_join(base, name), compression=None)
            data = _gzip("\n".join(lines).encode())
            out.write(data)
            blocks.append((lines[0].split("\t")[0], lines[-1].split("\t")[0], at, len(data), len(lines)))
            at, lines = at + len(data), []

        try:
            for batch in batches:
                for key, page_id, kind, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    lines.append(f"{key}\t{'-' if page_id is None else page_id}\t{kind}\t{archive}\t{offset}\t{length}")
                    if len(lines) == block_lines:
                        flush()
            if lines:
                flush()
            if blocks:
                page = _gzip("\n".join("\t".join(map(str, b)) for b in blocks).encode())
                out.write(page)
                yield _batch([(blocks[0][0], blocks[-1][1], _join(root, name), at, len(page), len(blocks), sum(b[4] for b in blocks))], FILES)
        finally:
            if out is not None:
                out.close()

    slots = manifest.sparkSession.sparkContext.defaultParallelism
    ordered = manifest.repartitionByRange(max(slots, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return ordered.mapInArrow(run, FILES)


@lru_cache(maxsize=64)
def _page(uri: str, offset: int, length: int) -> tuple[list[str], list[str], list[tuple[int, int, int]]]:
    """A file's block directory: first keys, last keys, and (offset, length, lines)."""
    rows = [x.split("\t") for x in _block(uri, offset, length)]
    return [r[0] for r in rows], [r[1] for r in rows], [(int(r[2]), int(r[3]), int(r[4])) for r in rows]


def directory(files: DataFrame) -> DataFrame:
    """All block directories, one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch([(a, b, uri, *x) for a, b, x in zip(*_page(uri, offset, length))], DIRECTORY)

    return files.select("index_file", "page_offset", "page_length").mapInArrow(run, DIRECTORY)


def _spanning(first: list[str], last: list[str], key: str) -> range:
    """The entries, in sorted order, whose keys may be ``key``, by binary search on both ends."""
    return range(bisect_left(last, key), bisect_right(first, key))


def _range(uri: str, offset: int, length: int) -> bytes:
    files, at = _fs(uri)
    with files.open_input_file(at) as f:
        return f.read_at(length, offset)


def _block(uri: str, offset: int, length: int) -> list[str]:
    return zlib.decompress(_range(uri, offset, length), 31).decode().split("\n")


def search(lines: list[str], key: str) -> list[str]:
    """The lines of a sorted block whose key is ``key``, by binary search on both ends."""
    own = lambda x: x.partition("\t")[0]
    return lines[bisect_left(lines, key, key=own) : bisect_right(lines, key, key=own)]


def lookup(files: DataFrame, url: str) -> list[dict]:
    """Records captured for one url.

    Only the files that can hold the key come to the driver: files overlap in key only where one
    url fills several of them.
    """
    key = url_key(url)
    found = []
    for f in files.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "last_key").toLocalIterator():
        first, last, blocks = _page(f["index_file"], f["page_offset"], f["page_length"])
        for k in _spanning(first, last, key):
            for line in search(_block(f["index_file"], *blocks[k][:2]), key):
                _, _, _, archive, offset, length = line.split("\t")
                found.append(parse(zlib.decompress(_range(archive, int(offset), int(length)), 31)))
    return found


def _captures(lines: list[str]) -> list[tuple]:
    """Records of index lines, read by byte range in file order; a response's size and digest are those of
    the bytes that were read."""
    spans: dict[str, list[tuple[int, int]]] = {}
    for line in lines:
        _, _, _, archive, o, n = line.split("\t")
        spans.setdefault(archive, []).append((int(o), int(n)))
    rows = []
    for archive, where in spans.items():
        files, at = _fs(archive)
        with files.open_input_file(at) as f:
            for o, n in sorted(where):
                r = parse(zlib.decompress(f.read_at(n, o), 31))
                size, digest, ok = r["payload_bytes"], r["payload_digest"], None
                if r["payload"] is not None:
                    size, digest = len(r["payload"]), hashlib.sha256(r["payload"]).hexdigest()
                    ok = (size, digest) == (r["payload_bytes"], r["payload_digest"])
                rows.append((r["page_id"], r["url"], size, digest, r["record_type"], r["refers_to"], ok))
    return rows


def url_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``(url_key)``: the distinct keys of a column of urls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(k,) for k in sorted({url_key(u) for u in batch.column(0).to_pylist()})], "url_key string")

    return pages.select(url_col).mapInArrow(run, "url_key string").distinct()


def find(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Every capture of the keys (column ``url_key``, each once), through the two levels of the index.

    ``intact``: a response's bytes have the digest named.  What is broadcast is one row per index file.
    """
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    top = sorted(map(tuple, files.select("first_key", "last_key", "index_file", "page_offset", "page_length").collect()))
    shared = spark.sparkContext.broadcast(top)

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [t[0] for t in shared.value], [t[1] for t in shared.value]
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for f in _spanning(firsts, lasts, key):
                    first, last, blocks = _page(*shared.value[f][2:])
                    rows += [(key, shared.value[f][2], *blocks[k][:2]) for k in _spanning(first, last, key)]
            yield _batch(rows, "url_key string, index_file string, byte_offset long, byte_length long")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lines, met = None, [], []
        for batch in batches:
            for key, *at in zip(*(c.to_pylist() for c in batch.columns)):
                if at != block:
                    if met:
                        yield _batch(_captures(met), CAPTURE)
                    block, lines, met = at, _block(*at), []
                met += search(lines, key)
        if met:
            yield _batch(_captures(met), CAPTURE)

    # keys in order share directories and blocks
    where = keys.select("url_key").repartitionByRange(tasks, "url_key").sortWithinPartitions("url_key").mapInArrow(blocks_of, "url_key string, index_file string, byte_offset long, byte_length long")
    return where.repartition(tasks, "index_file", "byte_offset").sortWithinPartitions("index_file", "byte_offset", "url_key").mapInArrow(records, CAPTURE)


def read_captures(blocks: DataFrame) -> DataFrame:
    """Every capture of the blocks of a directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in zip(*(c.to_pylist() for c in batch.columns)):
                yield _batch(_captures(_block(*at)), CAPTURE)

    slots = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.select("index_file", "byte_offset", "byte_length").repartition(max(slots, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, CAPTURE)


def archive(pages: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Archives and index of ``pages`` in the shared folder: ``(manifest, files)``."""
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.table(write_archives(pages, scratch, f"{scratch.path}/archives", **kw), "manifest")
    files = scratch.table(build_index(manifest, f"{scratch.path}/index"), "files")
    scratch.close(files)
    return manifest, files


def checked(captures: DataFrame, scratch: Scratch) -> DataFrame:
    """``captures``, written, if each response's bytes are those that its header names and each revisit
    names the bytes of its response; a ``ValueError`` with their number else."""
    got = scratch.table(captures, "captures")
    damaged = got.filter("record_type = 'response' AND NOT intact").count()
    # what many revisits say of one response is said once
    said = got.filter("record_type = 'revisit'").select("refers_to", "payload_bytes", "payload_digest").distinct()
    responses = got.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    unanswered = said.join(responses, ["refers_to", "payload_bytes", "payload_digest"], "left_anti").count()
    if damaged or unanswered:
        raise ValueError(f"damaged archive: {damaged} responses differ from their headers, {unanswered} revisits from their responses")
    return got


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    _, files = archive(pages)
    scratch = Scratch(spark, "captures")
    got = checked(find(files, url_keys(pages)), scratch)
    return scratch.close(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first_id FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
