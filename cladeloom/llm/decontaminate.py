"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items become lower-case ASCII-alphanumeric words (other bytes above 127 count as
letters).  For an item of ``w`` words, a text's windows are its runs of ``w`` consecutive words.
A window's fingerprint is the weighted SimHash of its 5-word shingles; items stand in a
multi-index: the fingerprint is cut into 4 blocks of 16 bits, and each block lists the items
within 4 bits of every value, so all items within radius 19 are found (a distance of 19 or less
leaves some block with at most 4).  Candidates are verified by exact weighted-shingle similarity,
the sum of minima over the sum of maxima of shingle weights with multiplicity; a shingle weighs
``log(1 + items / items that have it)``.

Windows that share no shingle with an item of their size have similarity zero and are not
fingerprinted; item shingles are looked up for every position of every text.

Texts never leave their task and nothing is shuffled but the found pairs and, above
``items_per_block`` items, the items' shingles.  Items are taken in blocks of about
``items_per_block``, one pass over the texts each.  The item count and the shingles' frequencies are
those of the whole benchmark whatever the blocks are: with a block go the frequencies of all shingles
that stand in several items.  A shingle of one item weighs as much as one of none.

Defined cases: null and empty texts and items match nothing; an item of fewer than 5 words has
one shingle, the whole sequence; a text shorter than an item has one window, the whole text;
repeated rows are reported alike; of equal similarities the first window counts; null ids are
carried; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read, with_bytes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4
ITEMS_PER_BLOCK = 2000
KEPT_INDEXES = 4

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


def shingle_hashes(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``k`` word hashes (of the whole sequence, if it is shorter)."""
    k = min(k, len(hashes))
    if not k:
        return np.empty(0, np.uint64)
    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = _mix(out * _P + hashes[j : j + n])
    return out


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def similarity(a: Counter, b: Counter, weight) -> float:
    low = sum(weight(s) * min(n, b[s]) for s, n in a.items() if s in b)
    high = sum(weight(s) * n for s, n in a.items()) + sum(weight(s) * n for s, n in b.items()) - low
    return low / high if high else 0.0


class Index:
    """Items, their shingles, and the multi-index over their fingerprints."""

    def __init__(self, items: list[tuple[int | None, bytes]], shingle: int = SHINGLE, radius: int = RADIUS, total: int | None = None, shared: dict[int, int] | None = None):
        """``total`` and ``shared`` (shingles of several items, with their numbers of items) are those of
        the whole benchmark where ``items`` are a part of it."""
        self.k, self.radius = shingle, radius
        rows = [(i, w) for i, raw in items if (w := words_of(raw))]
        self.ids = [i for i, _ in rows]
        self.size = [len(w) for _, w in rows]
        vocabulary = sorted({x for _, w in rows for x in w})
        self.word = {x: j + 1 for j, x in enumerate(vocabulary)}
        self.hash = np.concatenate([np.zeros(1, np.uint64), _word_hashes(vocabulary)])
        bags = [Counter(shingle_hashes(self.hash[[self.word[x] for x in w]], shingle).tolist()) for _, w in rows]
        self.bags = bags
        total = len(rows) if total is None else total
        df = Counter(s for b in bags for s in b) if shared is None else shared
        self.rare = math.log1p(total)
        self.weights = {s: math.log1p(total / n) for s, n in df.items()}
        self.prints = np.array([self.fingerprint_bag(b) for b in bags], np.uint64)
        # shingle -> items, by a sorted key table; short items are keyed by their only shingle
        pairs = sorted((s, j) for j, b in enumerate(bags) for s in b)
        keys = np.array([s for s, _ in pairs], np.uint64)
        self.keys, self.first = np.unique(keys, return_index=True)
        self.first = np.append(self.first, len(pairs))
        self.owners = np.array([j for _, j in pairs], np.int64)
        self.lengths = sorted({min(shingle, n) for n in self.size})
        self._blocks()

    def _blocks(self) -> None:
        reach = self.radius // BLOCKS
        masks = np.array([sum(1 << b for b in bits) for r in range(reach + 1) for bits in combinations(range(16), r)], np.uint16)
        parts = self.prints.view(np.uint16).reshape(-1, BLOCKS) if len(self.prints) else np.empty((0, BLOCKS), np.uint16)
        self.table = []
        for b in range(BLOCKS):
            value = (parts[:, b : b + 1] ^ masks).ravel()
            owner = np.repeat(np.arange(len(parts)), len(masks))
            order = np.argsort(value, kind="stable")
            self.table.append((np.searchsorted(value[order], np.arange(65537)), owner[order]))

    def weight(self, s: int) -> float:
        return self.weights.get(s, self.rare if self.rare else 1.0)

    def fingerprint_bag(self, bag: Counter) -> int:
        h = np.array(list(bag), np.uint64)
        w = np.array([self.weight(s) * n for s, n in bag.items()])
        return _pack((2 * (_bits(h) * w[:, None]).sum(axis=0) > w.sum())[None])[0]

    def near(self, value: int) -> list[int]:
        """All items whose fingerprint is within the radius, by the block tables."""
        parts = np.array([value], np.uint64).view(np.uint16)
        met = [own[at[p] : at[p + 1]] for (at, own), p in zip(self.table, parts.astype(np.int64))]
        found = np.unique(np.concatenate(met))
        return found[np.bitwise_count(self.prints[found] ^ np.uint64(value)) <= self.radius].tolist()


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def matches(raw: bytes, index: Index, threshold: float = SIMILARITY) -> list[tuple[int, int, int, float]]:
    """``(item position, first word, words, similarity)`` of the best window per item."""
    words = words_of(raw)
    if not words or not index.ids:
        return []
    get = index.word.get
    known = np.array([get(w, 0) for w in words], np.int64)
    starts: dict[int, set[int]] = {}  # window size -> starts
    for k in index.lengths:
        if len(words) < k:
            continue
        n = len(words) - k + 1
        inside = known != 0
        run = np.ones(n, bool)
        for j in range(k):
            run &= inside[j : j + n]
        at = np.flatnonzero(run)
        if not len(at):
            continue
        h = np.full(len(at), k, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = _mix(h * _P + index.hash[known[at + j]])
        slot = np.searchsorted(index.keys, h)
        slot[slot == len(index.keys)] = 0
        hit = index.keys[slot] == h
        for p, s in zip(at[hit].tolist(), slot[hit].tolist()):
            for size in {index.size[j] for j in index.owners[index.first[s] : index.first[s + 1]].tolist()}:
                top = max(0, len(words) - size)
                starts.setdefault(size, set()).update(range(max(0, min(p + k - size, top)), min(p, top) + 1))
    best: dict[int, tuple[float, int, int]] = {}
    for size, where in starts.items():
        for lo, hi in _runs(sorted(where)):
            span = words[lo : hi + size]
            h = shingle_hashes(_word_hashes(span), index.k)
            per = max(1, min(size, len(span)) - index.k + 1)
            w = np.fromiter(map(index.weight, h.tolist()), float, len(h))
            votes = np.concatenate([np.zeros((1, 64)), np.cumsum(_bits(h) * w[:, None], axis=0)])
            total = np.concatenate([[0.0], np.cumsum(w)])
            count = len(h) - per + 1
            bits = 2 * (votes[per : per + count] - votes[:count]) > (total[per : per + count] - total[:count])[:, None]
            bags: dict[int, Counter] = {}
            for o, value in enumerate(_pack(bits).tolist()):
                for j in index.near(value):
                    if index.size[j] != size:
                        continue
                    if o not in bags:
                        bags[o] = Counter(h[o : o + per].tolist())
                    got = similarity(bags[o], index.bags[j], index.weight)
                    if got >= threshold - 1e-12 and (j not in best or (-got, lo + o) < (-best[j][0], best[j][1])):
                        best[j] = (got, lo + o, min(size, len(words)))
    return [(j, at, n, got) for j, (got, at, n) in sorted(best.items())]


def _runs(where: list[int]) -> Iterator[tuple[int, int]]:
    lo = hi = None
    for s in where:
        if lo is None or s > hi + 1:
            if lo is not None:
                yield lo, hi
            lo = s
        hi = s
    if lo is not None:
        yield lo, hi


_INDEXES: dict[tuple, Index] = {}


def _index(key: str, items: list, shingle: int, radius: int, total: int | None, shared: dict[int, int] | None) -> Index:
    """One index per worker process and block of items."""
    if (key, shingle, radius) not in _INDEXES:
        if len(_INDEXES) >= KEPT_INDEXES:
            _INDEXES.clear()
        _INDEXES[key, shingle, radius] = Index(items, shingle, radius, total, shared)
    return _INDEXES[key, shingle, radius]


def _frequencies(items: DataFrame, shingle: int) -> tuple[int, dict[int, int]]:
    """The number of items with words, and in how many items each shingle of several items stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(_word_hashes(words_of(raw)), shingle)) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["s"])

    sets = items.select("_bytes").mapInArrow(run, "s array<long>")
    shared = sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    return sets.filter("size(s) > 0").count(), {r["s"] % (1 << 64): r["n"] for r in shared.collect()}


def _blocks_of(benchmark: DataFrame, item_col: str, item_text: str, shingle: int, radius: int, items_per_block: int) -> list:
    """Per block of items the arguments of its index; counts and frequencies are the whole benchmark's."""
    items = with_bytes(benchmark, item_text).select(item_col, "_bytes")
    blocks = max(1, -(-items.count() // items_per_block))
    total, shared = _frequencies(items, shingle) if blocks > 1 else (None, None)
    every = repr((total, sorted(shared.items()) if shared else shared))
    out = []
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("_bytes"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = sorted(((r[0], bytes(r[1])) for r in own.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        out.append((xxhash.xxh64_hexdigest(repr(rows) + every), rows, shingle, radius, total, shared))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``(id, item, first_word, n_words, similarity)``: each text's best window per item."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, first_word long, n_words long, similarity double"
    source = with_bytes(docs, text_col).select(id_col, "_bytes")
    out = None
    for block in _blocks_of(benchmark, item_col, item_text, shingle, radius, items_per_block):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(*block)
            for batch in batches:
                at, got = [], []
                for i, raw in enumerate(batch.column(1).to_pylist()):
                    for m in matches(raw, index, threshold):
                        at.append(i)
                        got.append(m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())), pa.array([index.ids[j] for j, *_ in got], item_type),
                        pa.array([m[1] for m in got], pa.int64()), pa.array([m[2] for m in got], pa.int64()), pa.array([m[3] for m in got], pa.float64()),
                    ],
                    names=[id_col, item_col, "first_word", "n_words", "similarity"],
                )

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, whatever their id; nothing is shuffled."""
    at, out = docs.columns.index(text_col), docs
    for block in _blocks_of(benchmark, item_col, item_text, shingle, radius, items_per_block):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(*block)
            for batch in batches:
                yield batch.filter(pa.array([not matches((t or "").encode(), index, threshold) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
