"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``2 r`` bits share a point that is within ``r``
bits of both.  Every distinct fingerprint therefore emits all points within ``r`` (for
``r = 1``: itself and 64 more), points are shuffled, and fingerprints that meet on a point are
verified and linked.  A point has at most 65 fingerprints around it, however the corpus is
skewed, because copies are folded into their fingerprint first; links run along a chain through
the sorted members of a point, so no point emits all its pairs.  Fingerprints themselves are linked
and grouped; ids come in only afterwards, as the smallest of a group.

Defined cases: null text counts as empty; a text without words has fingerprint zero and is
linked like any other; a text of fewer words than a shingle has one shingle, the whole
sequence; repeated rows share a fingerprint; rows with a null id link like any other and take
their group's smallest id (null where the group has none); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read, with_bytes
from .components import connected_components

BITS = 64
_CHUNK = 1 << 15


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values."""
    words = raw.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        a, b = starts[at : min(at + _CHUNK, n)].tolist(), ends[at + k - 1 : min(at + _CHUNK, n) + k - 1].tolist()
        votes += _votes(np.array([digest(joined[x:y], seed) for x, y in zip(a, b)], np.uint64))
    return _majority(votes, n)


def _votes(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(votes: np.ndarray, n: int) -> int:
    return int(np.packbits((2 * votes > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes that are there already."""
    return _majority(sum(_votes(h[at : at + _CHUNK]) for at in range(0, len(h), _CHUNK)), len(h))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp)``: the fingerprint as a signed 64-bit integer."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x, shingle, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=[id_col, "fp"])

    return with_bytes(docs, text_col).select(id_col, "_bytes").mapInArrow(run, f"`{id_col}` {kind}, fp long")


def ball(radius: int) -> list[int]:
    """All masks of at most ``radius`` bits, as signed integers."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(BITS), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``(fp, other)``: links between fingerprints within ``radius`` bits.

    ``fps`` holds each distinct fingerprint once.  Every pair within the radius is joined by a path
    of links.  For an odd or larger radius, members of a point may be up to twice the half radius
    apart, so each link is verified; with an even radius all pass.
    """
    half = (radius + 1) // 2
    points = fps.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in ball(half)])).alias("point"))
    met = points.select("fp", F.lag("fp").over(Window.partitionBy("point").orderBy("fp")).alias("other")).filter("other is not null").distinct()
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``(id, fp, component_id)``; component_id is the smallest id reachable over links.

    ``radius`` must be even: then all members of a point are within it and a chain through them
    loses no link.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, id_col, text_col, shingle, seed), "fps")
    reps = fps.groupBy("fp").agg(F.min(id_col).alias("rep"))
    found = connected_components(links(reps.select("fp"), radius), scratch, "fp", "other")
    at = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    low = at.groupBy("component").agg(F.min("rep").alias("component_id"))
    group = at.join(low, "component").select("fp", "component_id")
    return scratch.close(fps.join(group, "fp", "left").select(id_col, "fp", "component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    out = found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out
