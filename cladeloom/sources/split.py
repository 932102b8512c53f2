"""FASTA and MAF files of any size, read by many tasks.

A file is cut into byte ranges; blocked gzip is cut where a block begins, other gzip is one range.  A first
pass says of each range what a reader has to know that starts there: how many records, bases and lines
its bytes hold, and how its last line stands.  From these, one row a range, follows the state at every
range's beginning; the second pass reads each range by itself and goes on beyond it only to finish what
began in it.  Results are those of reading the file in one, wherever it is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

SPLIT = 1 << 26
PIECE = 1 << 20
RANGES = "id long, root string, path string, lo long, hi long, blocked boolean"
_BLOCK = b"\x1f\x8b\x08\x04"


class State(NamedTuple):
    """Where a reader stands: number of the record and its bases so far, lines ended, inside a header or at a line's start."""

    record: int = -1
    base: int = 0
    lines: int = 0
    in_header: bool = False
    at_start: bool = True


def ranges(spark: SparkSession, path: str, wanted, split: int = SPLIT) -> DataFrame:
    """``RANGES`` of the files under ``path`` whose names the pattern ``wanted`` finds."""
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    store, at = pafs.FileSystem.from_uri(uri)
    info = store.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=True))
    rows = []
    for x in sorted((x for x in found if x.type == pafs.FileType.File and wanted.search(x.path)), key=lambda x: x.path):
        blocked = False
        if x.path.endswith(".gz"):
            with store.open_input_file(x.path) as f:
                blocked = _is_block(f.read_at(min(18, x.size), 0))
        step = split if blocked or not x.path.endswith(".gz") else max(1, x.size)
        rows += [(len(rows) + k, uri, x.path, lo, min(lo + step, x.size), blocked) for k, lo in enumerate(range(0, x.size, step))]
    df = spark.createDataFrame(rows, RANGES)
    return df.repartitionByRange(max(1, min(len(rows), 10_000)), "id") if rows else df


def _is_block(head: bytes) -> bool:
    return head[:4] == _BLOCK and head[12:14] == b"BC"


def _pieces(root: str, path: str, lo: int, hi: int, blocked: bool) -> tuple[Iterator[bytes], Iterator[bytes]]:
    """The decompressed bytes of a range, and what comes behind it."""
    store, _ = pafs.FileSystem.from_uri(root)
    if path.endswith(".gz") and not blocked:

        def whole() -> Iterator[bytes]:
            with store.open_input_stream(path, compression="gzip") as f:
                while piece := f.read(PIECE):
                    yield piece

        return whole(), iter(())
    size = store.get_file_info(path).size

    def plain(lo: int, hi: int) -> Iterator[bytes]:
        with store.open_input_file(path) as f:
            for at in range(lo, hi, PIECE):
                yield f.read_at(min(PIECE, hi - at), at)

    def blocks(lo: int, hi: int) -> Iterator[bytes]:
        """Blocks that begin in a range; its first is the first place from which a block leads to another, or to the end."""
        with store.open_input_file(path) as f:
            at = lo
            while at and at < hi:
                near = f.read_at(min(PIECE, size - at), at)
                k = near.find(_BLOCK)
                if k < 0:
                    at += max(1, len(near) - 3)
                    continue
                head = f.read_at(min(18, size - at - k), at + k)
                if _is_block(head):
                    following = at + k + int.from_bytes(head[16:18], "little") + 1
                    if following == size or _is_block(f.read_at(min(18, max(0, size - following)), following)):
                        at += k
                        break
                at += k + 1
            while at < hi:
                n = int.from_bytes(f.read_at(18, at)[16:18], "little") + 1
                yield zlib.decompress(f.read_at(n, at), 31)
                at += n

    read = blocks if blocked else plain
    return read(lo, hi), read(hi, size)


def _summary(raw: bytes) -> tuple:
    """``(bytes, lines, first_is_header, first_bases, headers, bases, in_header, at_start)``: the first line's
    and that of all others; ``bases`` are those behind the last header, or of all other lines."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b == 10)
    first = b[: ends[0]] if len(ends) else b
    starts = ends[:-1] + 1 if len(ends) and ends[-1] == len(b) - 1 else ends + 1
    head = b[starts] == ord(">")
    n = np.add.reduceat(b > 32, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    at = np.flatnonzero(head)
    at_start = bool(len(ends) and ends[-1] == len(b) - 1)
    return len(b), len(ends), bool(len(b) and b[0] == ord(">")), int((first > 32).sum()), len(at), int(n[at[-1] + 1 :].sum() if len(at) else n.sum()), bool(len(head) and head[-1] and not at_start), at_start


def after(s: State, size: int, lines: int, first_is_header: bool, first_bases: int, headers: int, bases: int, in_header: bool, at_start: bool) -> State:
    """The state behind a range, from that before it and the range's summary."""
    if not size:
        return s
    header = first_is_header if s.at_start else s.in_header
    record, base = (s.record + 1, 0) if header and s.at_start else (s.record, s.base if header else s.base + first_bases)
    if not lines:
        return State(record, base, s.lines, header, False)
    if headers:
        record, base = record + headers, bases
    else:
        base += bases
    return State(record, base, s.lines + lines, in_header, at_start)


def states(found: DataFrame) -> DataFrame:
    """The ranges with the state at the beginning of each: one row a range comes to the driver."""
    names = ["size", "lines", "first_is_header", "first_bases", "headers", "bases", "in_header", "at_start"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                got = _summary(b"".join(_pieces(row["root"], row["path"], row["lo"], row["hi"], row["blocked"])[0]))
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns), *(pa.array([x], t) for x, t in zip(got, types))], names=[*batch.schema.names, *names])

    schema = f"{RANGES}, size long, lines long, first_is_header boolean, first_bases long, headers long, bases long, in_header boolean, at_start boolean"
    out, state, path = [], State(), None
    rows = sorted(found.mapInArrow(scan, schema).collect(), key=lambda r: r["id"])
    for r in rows:
        if r["path"] != path:
            state, path = State(), r["path"]
        out.append((*r[:6], *state))
        state = after(state, *r[6:])
    df = found.sparkSession.createDataFrame(out, f"{RANGES}, record long, base long, lines long, in_header boolean, at_start boolean")
    return df.repartitionByRange(max(1, min(len(out), 10_000)), "id") if out else df


def _segments(raw: bytes, s: State) -> list[tuple[int, int, bytes, bool]]:
    """``(record, first base, bases, goes on)`` of a range's bytes; only the last record may go on beyond."""
    out: list[list] = []
    record, base, parts = s.record, s.base, []
    lines = raw.split(b"\n")
    for k, line in enumerate(lines):
        fresh = k > 0 or s.at_start
        if fresh and line[:1] == b">":
            out.append([record, base, b"".join(parts), False])
            record, base, parts = record + 1, 0, []
        elif not (k == 0 and not s.at_start and s.in_header):
            parts.append(b"".join(line.split()))
    out.append([record, base, b"".join(parts), True])
    return [tuple(x) for x in out if x[0] >= 0]


def _beyond(pieces: Iterator[bytes], in_header: bool, at_start: bool, want: int) -> tuple[bytes, bool]:
    """Bases of the record that a range ends in, up to ``want``, and whether the record ended."""
    got, parts = 0, []
    for piece in pieces:
        for k, line in enumerate(piece.split(b"\n")):
            if k:
                in_header, at_start = False, True
            if at_start and line[:1] == b">":
                return b"".join(parts), True
            if line:
                at_start = False
                if not in_header:
                    parts.append(b"".join(line.split()))
                    got += len(parts[-1])
        if got >= want:
            return b"".join(parts), False
    return b"".join(parts), True


CHUNKS = "species string, rec_idx long, start long, own long, seq string"


def fasta_chunks(spark: SparkSession, path: str, wanted, size: int, overlap: int, split: int = SPLIT) -> DataFrame:
    """``CHUNKS`` of FASTA files: each chunk by the range that its first base lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                s = State(r["record"], r["base"], r["lines"], r["in_header"], r["at_start"])
                own, more = _pieces(r["root"], r["path"], r["lo"], r["hi"], r["blocked"])
                raw = b"".join(own)
                species = wanted.sub("", r["path"].rsplit("/", 1)[-1])
                for record, base, seq, goes_on in _segments(raw, s):
                    first = -(-base // size) * size
                    last = (base + len(seq) - 1) // size * size
                    if not seq or last < first:
                        continue
                    ended = True
                    if goes_on:
                        end = after(s, *_summary(raw))
                        rest, ended = _beyond(more, end.in_header, end.at_start, last + size + overlap - base - len(seq))
                        seq += rest
                    for at in range(first, last + 1, size):
                        part = seq[at - base : at - base + size + overlap]
                        own_n = min(size, len(part)) if ended else size
                        yield pa.RecordBatch.from_arrays([pa.array([species]), pa.array([record]), pa.array([at]), pa.array([own_n]), pa.array([part.decode("utf-8", "replace")])], names=["species", "rec_idx", "start", "own", "seq"])

    return states(ranges(spark, path, wanted, split)).mapInArrow(run, CHUNKS)


def maf_lines(spark: SparkSession, path: str, wanted, split: int = SPLIT) -> DataFrame:
    """``(path, first, text)`` of MAF files: whole blocks, by the range that their first line begins in, and
    the number of the text's first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, more = _pieces(r["root"], r["path"], r["lo"], r["hi"], r["blocked"])
                raw, first = b"".join(own), r["lines"]
                if not r["at_start"]:  # the line that goes on from before is not this range's
                    cut = raw.find(b"\n") + 1
                    raw, first = (raw[cut:], first + 1) if cut else (b"", first)
                if not raw:
                    continue
                tail = b""
                for piece in chain(more, [b"\n\n"]):  # up to the end of the block: a blank line or another block
                    tail += piece
                    at = _block_end(raw, tail)
                    if at is not None:
                        tail = tail[:at]
                        break
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([first]), pa.array([(raw + tail).decode("utf-8", "replace")])], names=["path", "first", "text"])

    return states(ranges(spark, path, wanted, split)).mapInArrow(run, "path string, first long, text string")


def _block_end(raw: bytes, tail: bytes) -> int | None:
    """Where in ``tail`` the block that ``raw`` ends in is over; None if that cannot be seen yet."""
    at = 0 if raw.endswith(b"\n") else tail.find(b"\n") + 1
    if not raw.endswith(b"\n") and not at:
        return None
    while True:
        end = tail.find(b"\n", at)
        if end < 0:
            return None
        line = tail[at:end].split()
        if not line or line[0] == b"a":
            return at
        at = end + 1
