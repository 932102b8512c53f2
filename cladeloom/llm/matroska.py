"""Matroska media columns: variable-length EBML elements, clusters, lacing and cues.

``mux`` stores a payload as one 8-bit PCM track: 576-sample frames at 48 kHz (12 ms each) in
laced SimpleBlocks inside clusters, with a cue point per cluster.  ``demux`` walks the EBML tree
and returns the packet table: track, timestamp, cluster, block, lace index, byte offset, size.

Times of files from elsewhere: clusters, blocks, cues and the duration count in units of
TimestampScale.  The frames of a lace are DefaultDuration of their track apart; without one, PCM
frames follow from their size, and frames of other codecs get their block's time.  A BlockGroup's
block is a keyframe unless the group has a ReferenceBlock.

Defined cases: null and empty text are stored as one frame of padding bytes (255); payloads are
padded to a positive multiple of 576; null media gives null features; truncated or foreign bytes
raise ``ValueError`` in ``demux``; unknown elements are skipped; unknown-size segments and
clusters are read to the end of their parent.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, with_bytes

FRAME = 576
RATE = 48_000
FRAME_MS = 12
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 64

# Element ids of the published Matroska specification.
EBML, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is reserved for unknown."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
        if width > 8:
            raise ValueError("too large for a variable-length integer")
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace_sizes(kind: int, sizes: list[int]) -> bytes:
    if kind == FIXED:
        return b""
    if kind == XIPH:
        return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    out = vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width, d = 1, b - a
        while abs(d) > (1 << 7 * width - 1) - 1:
            width += 1
        out += vint(d + (1 << 7 * width - 1) - 1, width)
    return out


def block(frames: list[bytes], relative_ms: int, kind: int, track: int = 1) -> bytes:
    if len(frames) == 1:
        kind = NO_LACE
    head = vint(track) + struct.pack(">hB", relative_ms, 0x80 | kind << 1)
    if kind != NO_LACE:
        head += bytes([len(frames) - 1]) + _lace_sizes(kind, [len(f) for f in frames])
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def pad(raw: bytes) -> bytes:
    want = max(1, -(-len(raw) // FRAME)) * FRAME
    return raw + b"\xff" * (want - len(raw))


def mux(payload: bytes) -> bytes:
    """One audio track; lacing kinds rotate over the blocks so that readers meet them all."""
    if not payload or len(payload) % FRAME:
        raise ValueError("payload must be a positive multiple of the frame size")
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * FRAME_MS))) + element(MUXING_APP, b"cladeloom") + element(WRITING_APP, b"cladeloom"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    per = FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for c in range(0, len(frames), per):
        base = c * FRAME_MS
        parts = [uint(TIMESTAMP, base)]
        for k, b in enumerate(range(c, min(c + per, len(frames)), FRAMES_PER_BLOCK)):
            parts.append(block(frames[b : min(b + FRAMES_PER_BLOCK, c + per)], (b - c) * FRAME_MS, (FIXED, XIPH, EBML_LACE)[k % 3]))
        whole = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(whole)
        at += len(whole)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    cluster: int
    block: int
    lace: int
    offset: int
    size: int
    keyframe: bool

    @property
    def timestamp_ms(self) -> int:
        return self.timestamp_ns // 1_000_000


class Track(NamedTuple):
    number: int
    codec: str
    rate: float
    bits: int
    channels: int
    frame_ns: int  # 0: not given


class Media(NamedTuple):
    doc_type: str
    packets: list[Packet]
    tracks: list[Track]
    cues: list[tuple[int, int, int]]  # time in ms, track, position of the cluster
    cluster_at: list[int]
    duration_ms: float
    laced: tuple[int, int, int, int]


def _ident(buf: bytes, at: int) -> tuple[int, int]:
    if at >= len(buf) or buf[at] < 0x10:
        raise ValueError(f"no element id at byte {at}")
    width = 9 - buf[at].bit_length()
    return int.from_bytes(buf[at : at + width], "big"), at + width


def _size(buf: bytes, at: int) -> tuple[int | None, int]:
    if at >= len(buf) or not buf[at]:
        raise ValueError(f"no element size at byte {at}")
    width = 9 - buf[at].bit_length()
    if at + width > len(buf):
        raise ValueError("truncated size")
    ones = (1 << 7 * width) - 1
    n = int.from_bytes(buf[at : at + width], "big") & ones
    return (None if n == ones else n), at + width


def _frames(buf: bytes, at: int, end: int) -> tuple[int, int, bool, int, list[tuple[int, int]]]:
    """track, relative time, keyframe, lacing kind and (offset, size) of each frame."""
    track, at = _size(buf, at)
    if track is None or at + 3 > end:
        raise ValueError(f"no block header before byte {end}")
    relative, flags = struct.unpack_from(">hB", buf, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACE:
        return track, relative, bool(flags & 0x80), kind, [(at, end - at)]
    if at >= end:
        raise ValueError(f"no lace count before byte {end}")
    n = buf[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("uneven fixed lacing")
        sizes = [(end - at) // n] * n
    elif kind == XIPH:
        for _ in range(n - 1):
            run = at
            while at < end and buf[at] == 255:
                at += 1
            if at >= end:
                raise ValueError("lacing beyond its block")
            sizes.append(255 * (at - run) + buf[at])
            at += 1
    elif n > 1:
        first, at = _size(buf, at)
        if first is None:
            raise ValueError("unknown size in a lace")
        sizes.append(first)
        for _ in range(n - 2):
            was = at
            d, at = _size(buf, at)
            if d is None:  # all ones is a difference here
                d = (1 << 7 * (at - was)) - 1
            sizes.append(sizes[-1] + d - ((1 << 7 * (at - was) - 1) - 1))
    if kind != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond its block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, relative, bool(flags & 0x80), kind, out


def _float(body: bytes) -> float:
    """A float element; an empty one is zero."""
    if len(body) not in (0, 4, 8):
        raise ValueError("a float has 0, 4 or 8 bytes")
    return struct.unpack(">d" if len(body) == 8 else ">f", body)[0] if body else 0.0


def demux(buf: bytes) -> Media:
    doc_type, scale, ticks = "", 1_000_000, 0.0
    blocks: list[tuple[int, int, int, list[tuple[int, int]], bool]] = []  # track, time in ticks, cluster, frames, keyframe
    tracks: list[Track] = []
    cues: list[tuple[int, int, int]] = []
    cluster_at: list[int] = []
    laced = [0, 0, 0, 0]
    segment_at, base, track, place, positions, cue_time, in_group = -1, 0, {}, {}, [], 0, 0
    stack: list[tuple[int, int]] = [(0, len(buf))]
    at = 0
    while True:
        while len(stack) > 1 and at >= stack[-1][1]:
            ident, _ = stack.pop()
            if ident == TRACK_ENTRY:
                tracks.append(Track(track.get(TRACK_NUMBER, 0), track.get(CODEC_ID, ""), track.get(SAMPLING_FREQUENCY, 0.0), track.get(BIT_DEPTH, 0), track.get(CHANNELS, 1), track.get(DEFAULT_DURATION, 0)))
            elif ident == CUE_TRACK_POSITIONS:
                positions.append((place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER_POSITION, 0)))
            elif ident == CUE_POINT:
                cues += [(cue_time, *where) for where in positions]
        if at >= len(buf):
            break
        start = at
        ident, at = _ident(buf, at)
        size, at = _size(buf, at)
        end = stack[-1][1] if size is None else at + size
        if end > stack[-1][1]:
            raise ValueError(f"element {ident:x} at byte {start} runs over its parent")
        if size is None and ident not in (SEGMENT, CLUSTER):
            raise ValueError("unknown size")
        if ident in (CLUSTER, CUES, TRACKS, INFO) and stack[-1][0] == CLUSTER:  # the one before had no size
            stack.pop()
        if ident in PARENTS or ident == EBML:
            stack.append((ident, end))
            if ident == SEGMENT:
                segment_at = at
            elif ident == CLUSTER:
                cluster_at.append(start - segment_at)
            elif ident == BLOCK_GROUP:
                in_group = len(blocks)
            elif ident == TRACK_ENTRY:
                track = {}
            elif ident == CUE_POINT:
                positions, cue_time = [], 0
            elif ident == CUE_TRACK_POSITIONS:
                place = {}
            continue
        if ident in (SIMPLE_BLOCK, BLOCK):
            number, relative, key, kind, spans = _frames(buf, at, end)
            laced[kind] += 1
            blocks.append((number, base + relative, len(cluster_at) - 1, spans, key or ident == BLOCK))
        elif ident == REFERENCE_BLOCK:
            blocks[in_group:] = [(*b[:4], False) for b in blocks[in_group:]]
        elif ident == TIMESTAMP:
            base = int.from_bytes(buf[at:end], "big")
        elif ident == TIMESTAMP_SCALE:
            scale = int.from_bytes(buf[at:end], "big")
        elif ident == DOC_TYPE:
            doc_type = buf[at:end].decode()
        elif ident == DURATION:
            ticks = _float(buf[at:end])
        elif ident == SAMPLING_FREQUENCY:
            track[ident] = _float(buf[at:end])
        elif ident == CODEC_ID:
            track[ident] = buf[at:end].decode()
        elif ident in (TRACK_NUMBER, BIT_DEPTH, CHANNELS, DEFAULT_DURATION):
            track[ident] = int.from_bytes(buf[at:end], "big")
        elif ident == CUE_TIME:
            cue_time = int.from_bytes(buf[at:end], "big")
        elif ident in (CUE_TRACK, CUE_CLUSTER_POSITION):
            place[ident] = int.from_bytes(buf[at:end], "big")
        at = end
    if doc_type != "matroska" or segment_at < 0:
        raise ValueError("not a Matroska file with a segment")
    # scale and tracks may stand behind what they are needed for, so times are reckoned at the end
    known = {t.number: t for t in tracks}
    packets = [
        Packet(number, when * scale + extra, cluster, k, lace, offset, n, key)
        for k, (number, when, cluster, spans, key) in enumerate(blocks)
        for lace, ((offset, n), extra) in enumerate(zip(spans, _lace_times(known.get(number), spans)))
    ]
    cues = [(when * scale // 1_000_000, number, position) for when, number, position in cues]
    return Media(doc_type, packets, tracks, cues, cluster_at, ticks * scale / 1_000_000, tuple(laced))


def _lace_times(track: Track | None, spans: list[tuple[int, int]]) -> list[int]:
    """Nanoseconds from a block's time to each of its frames."""
    if track and track.frame_ns:
        return [k * track.frame_ns for k in range(len(spans))]
    if track and track.codec.startswith("A_PCM") and track.rate and track.bits:
        per_second, before, out = track.rate * track.channels * track.bits / 8, 0, []
        for _, n in spans:
            out.append(round(before * 1e9 / per_second))
            before += n
        return out
    return [0] * len(spans)


def payload_of(buf: bytes, media: Media, track: int = 1) -> bytes:
    view = memoryview(buf)
    return b"".join([view[p.offset : p.offset + p.size] for p in media.packets if p.track == track])


def seek(media: Media, ms: int) -> int | None:
    """The segment offset of the last cue at or before ``ms``."""
    before = [c for c in media.cues if c[0] <= ms]
    return max(before)[2] if before else None


def feature(payload: bytes, media: Media) -> str:
    """Packet and sample figures as ``name=value`` pairs."""
    samples = np.frombuffer(payload, np.uint8)
    turns = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    spans = [p.size for p in media.packets]
    cued = int([c[2] for c in media.cues] == media.cluster_at)
    none, xiph, fixed, ebml = media.laced
    return f"tracks={len(media.tracks)};clusters={len(media.cluster_at)};blocks={sum(media.laced)};packets={len(spans)};laced={none}/{xiph}/{fixed}/{ebml};cues={len(media.cues)};cues_exact={cued};duration_ms={int(media.duration_ms)};last_ms={media.packets[-1].timestamp_ms if spans else 0};sample_sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max(initial=0))};crossings={turns}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each text as the bytes of a Matroska file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    return with_bytes(docs, text_col).select(id_col, "_bytes").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


PACKET_SCHEMA = "track int, timestamp_ns long, cluster int, block int, lace int, byte_offset long, byte_size long, keyframe boolean"


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of every media value; null media has none."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        names = [id_col, *(x.split()[0] for x in PACKET_SCHEMA.split(", "))]
        for batch in batches:
            for i, buf in enumerate(batch.column(1).to_pylist()):
                rows = [] if buf is None else demux(buf).packets
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, {PACKET_SCHEMA}")


FEATURES = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]


def _features(buf: bytes | None) -> tuple:
    if buf is None:
        return (None,) * len(FEATURES)
    media = demux(buf)
    payload = payload_of(buf, media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(buf), hashlib.sha256(buf).hexdigest(), feature(payload, media)


def media_features(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Replace the media column with figures computed from its stored bytes."""
    rest = [f for f in media.schema if f.name != media_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*map(_features, batch.column(len(rest)).to_pylist()))) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, (_, t, _) in zip(got, FEATURES))], names=[*(f.name for f in rest), *(n for n, _, _ in FEATURES)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{n} {t}" for n, _, t in FEATURES)])
    return media.select(*(F.col(f"`{f.name}`") for f in rest), media_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store(read(spark, sf_dir, "documents")))
