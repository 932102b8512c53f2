"""The pipeline's near-duplicate stage: SimHash groups, completed to an exact Jaccard rule.

A text is the set of its runs of five words, each as a 64-bit hash; two texts are linked when the
Jaccard similarity of their sets is 0.8 or more.  Equal sets are folded into one representative.
Candidates come from two sides.  The SimHash operator's ball hashing groups fingerprints (of the
same shingles) that lie within two bits, and neighbours in such a group are candidates.  Texts at a
similarity of 0.8 differ in ten bits on average, beyond any ball that can be emitted, so a
prefix-filtered join finds every other pair: sets are put in one order of all shingles, rarest first,
and two sets that are similar enough share a shingle among the first ``n - ceil(0.8 n) + 1`` of each.
No pair is left out; candidates are verified on their whole sets, so no other pair is linked.

Any one order gives the same links, and frequencies only make it fast: shingles that repeat within
``CHUNK`` shingles of a task are counted, over all texts, and the ``LISTED`` most frequent come last.
A first pass finds the prefix shingles that several texts have; a bitmap of these, of fixed size, tells
the second which shingles to list.

Not every pair that shares a shingle is verified: first each set meets one hub of its largest bucket, in
``STARS`` rounds with other hubs, and linked members become one component.  Then the pairs of a
bucket that still lie in different components are joined, but for those whose sizes, or whose shingle's
places, leave too little to share.  The largest component of a bucket is never joined with itself.

Whole sets are far larger than their texts, so most pairs never meet theirs: of every set it is kept how
many shingles begin with each byte, and two sets share no more than the lesser number of every byte.
Only pairs for which that is enough are compared, and only their sets are moved.

Rows, not ids, are told apart (by a 128-bit hash of id and text): rows that share an id but not
their text are two documents, and rows without an id take part like any other.

Defined cases: null text counts as empty; texts without words are equal; a text of fewer words than
a shingle has one shingle, the whole sequence; letter case and white space do not count; repeated
rows are one document; of a group the row with the smallest id stays (rows without an id come
last, ties go by the row's hash); an empty table gives an empty result; other columns are carried
along by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_bytes
from .components import connected_components
from .simhash import links as simhash_links
from .simhash import of_hashes

SHINGLE = 5
STARS = 1
HUB_KEYS = 8
CHUNK = 1 << 21
LISTED = 1 << 17
BITMAP_BITS = 26
SEEN = 1 << 16
BATCH = "4m"  # of texts or whole sets that a task holds at once, beside what it makes of them


def shingle_set(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 values of the text's shingles; one value for a text without words."""
    words = raw.lower().split()
    k = min(shingle, len(words))
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64))


class Order:
    """The common order of shingles: unlisted ones by value, then the listed ones, rarest first."""

    def __init__(self, often: np.ndarray, counts: np.ndarray):
        rank = np.empty(len(often), np.int32)
        rank[np.lexsort((often, counts))] = np.arange(1, len(often) + 1)
        by_value = np.argsort(often)
        self.often, self.rank = often[by_value], rank[by_value]

    def prefix(self, values: np.ndarray, percent: int) -> np.ndarray:
        """The first shingles of a set, enough to share one with any set that is similar enough."""
        size = len(values) - -(-percent * len(values) // 100) + 1
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, values), len(self.often) - 1)
            rank = np.where(self.often[at] == values, self.rank[at], 0)
            if rank.any():
                values = values[np.argsort(rank, kind="stable")]
        return values[:size]


def sketch(values: np.ndarray) -> bytes:
    """How many shingles begin with each byte; above 255 counts as 255."""
    return np.minimum(np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def enough(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sketches (a row each) and sizes can be similar enough; never false for sets that are.

    What a sketch leaves out above 255 may all be shared."""
    both = np.minimum(a, b).sum(axis=1, dtype=np.int64) + np.minimum(na - a.sum(axis=1, dtype=np.int64), nb - b.sum(axis=1, dtype=np.int64))
    return both * (100 + percent) >= percent * (na + nb)


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a row by its id and text."""
    what = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(*what).alias("h1"), F.xxhash64(F.lit("second"), *what).alias("h2")]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_bytes(docs, text_col).select(F.col(f"`{id_col}`").alias("id"), *_row_key(id_col, text_col), "_bytes")


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h1, h2, digest, n, fp, sketch, kind)``; rows of kind 1 hold, in ``digest``, shingles that repeat
    within ``CHUNK`` shingles and their counts."""
    names = ["id", "h1", "h2", "digest", "n", "fp", "sketch", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind_of = [], 0, pa.null()

        def often() -> pa.RecordBatch:
            got, n = np.unique(np.concatenate(held), return_counts=True)
            raw = np.stack([got[n > 1], n[n > 1].astype(np.uint64)]).tobytes()
            return pa.RecordBatch.from_arrays([pa.nulls(1, kind_of), *(pa.array([x], t) for x, t in ((0, pa.int64()), (0, pa.int64()), (raw, pa.binary()), (0, pa.int64()), (0, pa.int64()), (b"", pa.binary()), (1, pa.int32())))], names=names)

        for batch in batches:
            kind_of = batch.column(0).type
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = [shingle_set(x) for x in part.column(3).to_pylist()]
                held += sets
                size += sum(map(len, sets))
                cols = [
                    *part.columns[:3], pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([of_hashes(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array(list(map(sketch, sets)), pa.binary()), pa.array([0] * len(sets), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                if size >= CHUNK:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    kind = docs.schema[id_col].dataType.simpleString()
    return _slim(docs, id_col, text_col).mapInArrow(run, f"id {kind}, h1 long, h2 long, digest binary, n long, fp long, sketch binary, kind int")


def _order(often: DataFrame) -> Order:
    """The most frequent repeated shingles of all texts; at most ``LISTED`` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                values, n = np.frombuffer(raw, np.uint64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["value", "n"])

    rows = often.select("digest").mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "value").limit(LISTED).toArrow()
    return Order(top.column("value").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64))


def _prefix_keys(docs: DataFrame, text_col: str, order, percent: int) -> DataFrame:
    """``(key, n)``: in how many texts' prefixes a shingle stands; a task counts a text that it met not
    long ago only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                values = shingle_set(raw)
                digest = xxhash.xxh128_digest(values.tobytes())
                if digest not in seen:
                    seen.add(digest)
                    out.append(order.value.prefix(values, percent))
            if len(seen) > SEEN:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["key"])

    return with_bytes(docs, text_col).select("_bytes").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n"))


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low ``bits`` bits of every key; what comes back has a fixed size."""
    word, bit = F.shiftright("key", 6).bitwiseAND((1 << bits - 6) - 1), F.col("key").bitwiseAND(63).cast("int")
    rows = keys.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _each_text(docs: DataFrame, text_col: str, found, columns: str) -> DataFrame:
    """What ``found(digest, values)`` gives for every text, but for those that the task met not long ago."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                values = shingle_set(raw)
                digest = xxhash.xxh128_digest(values.tobytes())
                if digest not in seen and (got := found(digest, values)) is not None:
                    seen.add(digest)
                    out.append(got)
            if len(seen) > SEEN:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], names=[x.split()[0] for x in columns.split(", ")])

    return with_bytes(docs, text_col).select("_bytes").mapInArrow(run, columns)


def _points(docs: DataFrame, text_col: str, order, bitmap, percent: int) -> DataFrame:
    """``(key, at, digest, n)``: the prefix shingles that other texts may share, with their places in the
    set's order."""

    def found(digest: bytes, values: np.ndarray) -> list[pa.Array] | None:
        bits, first = bitmap.value, order.value.prefix(values, percent)
        slot = first & np.uint64(64 * len(bits) - 1)
        at = np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
        if not len(at):
            return None
        return [pa.array(first[at].view(np.int64)), pa.array(at.astype(np.int32)), pa.array([digest] * len(at), pa.binary()), pa.array(np.full(len(at), len(values)))]

    return _each_text(docs, text_col, found, "key long, at int, digest binary, n long").dropDuplicates(["key", "digest"])


def _sets(docs: DataFrame, id_col: str, text_col: str, needed) -> DataFrame:
    """``(digest, s)``: the whole sets, as bytes, of the rows whose bit is set, and of few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy().view(np.uint64) & np.uint64(64 * len(needed.value) - 1)
            own = needed.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)
            texts = batch.column(1).filter(pa.array(own.astype(bool)))
            for lo in range(0, len(texts), 1000):
                raw = [shingle_set(x).tobytes() for x in texts.slice(lo, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(xxhash.xxh128_digest, raw)), pa.binary()), pa.array(raw, pa.binary())], names=["digest", "s"])

    return _slim(docs, id_col, text_col).select("h1", "_bytes").mapInArrow(run, "digest binary, s binary").dropDuplicates(["digest"])


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` of ``pairs``, digests, whose sketches leave enough to share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 256) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(enough(a, batch.column(4).to_numpy(), b, batch.column(5).to_numpy(), percent)))

    left, right = (reps.select(F.col("digest").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` of ``pairs``, digests, whose sets have a Jaccard similarity of at least ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("digest").alias("a"), F.col("s").alias("sa")), sets.select(F.col("digest").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _fit(percent: int) -> Column:
    """Sets whose sizes lie further apart cannot be that similar."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _room(percent: int) -> Column:
    """What two sets can share from the places of a shingle on, if it is the first that they share, has to be enough."""
    rest = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    return rest * (100 + percent) >= percent * (F.col("na") + F.col("nb"))


def _near_prints(reps: DataFrame) -> DataFrame:
    """Pairs ``(x, na, y, nb)`` of sets whose fingerprints the ball hashing links, by one set each."""
    one = reps.groupBy("fp").agg(F.min(F.struct("digest", "n")).alias("o"))
    met = simhash_links(one.select("fp")).join(one, "fp").select("other", F.col("o.digest").alias("x"), F.col("o.n").alias("na"))
    return met.join(one.withColumnRenamed("fp", "other"), "other").select("x", "na", F.col("o.digest").alias("y"), F.col("o.n").alias("nb"))


def _groups(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``(id, h1, h2, digest)`` and, per digest, the row that its group keeps: ``(digest, keep)``."""
    spark = docs.sparkSession
    signed = scratch.table(_signatures(docs, id_col, text_col), "sig", by="kind")
    sig = signed.filter("kind = 0").drop("kind")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")
    reps = scratch.table(sig.groupBy("digest").agg(F.min(row).alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "reps")
    near = scratch.table(_near_prints(reps).filter(_fit(percent)), "near")
    order = spark.sparkContext.broadcast(_order(signed.filter("kind = 1")))
    keys = scratch.table(_prefix_keys(docs, text_col, order, percent).filter("n > 1").select("key"), "keys")
    bitmap = spark.sparkContext.broadcast(_bitmap(keys, BITMAP_BITS))
    scratch.drop("keys")
    points = scratch.table(_points(docs, text_col, order, bitmap, percent), "points")
    shared = points.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    live = scratch.table(points.join(shared, "key"), "live")
    scratch.drop("points")  # tables that no later plan reads make room
    order.destroy()
    bitmap.destroy()
    # for the hubs, a set's first few shared shingles do
    few = live.groupBy("digest").agg(F.first("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("at", "key"))), 1, HUB_KEYS).alias("keys"))
    few = scratch.table(few.select("digest", "n", F.explode("keys.key").alias("key")), "few")
    links, groups = None, None
    for k in range(STARS + 1):
        if groups is not None:
            known = groups.withColumnRenamed("node", "digest")
            comp = lambda df: df.join(known, "digest", "left").withColumn("comp", F.coalesce("component", "digest")).drop("component")  # noqa: B023, E731
        else:
            comp = lambda df: df.withColumn("comp", F.col("digest"))
        if k < STARS:
            own = comp(few)
            hub = own.groupBy("key").agg(F.min_by(F.struct("digest", "n", "comp"), F.xxhash64("digest", F.lit(k))).alias("h"), F.count("*").alias("m"))
            own = own.join(hub, "key").groupBy("digest").agg(F.max_by(F.struct("n", "comp", "h"), F.struct("m", "key")).alias("o")).select("digest", "o.*")
            pairs = own.filter("comp <> h.comp").select(F.col("digest").alias("x"), F.col("n").alias("na"), F.col("h.digest").alias("y"), F.col("h.n").alias("nb"))
        else:
            scratch.drop("few")
            own = scratch.table(comp(live), "comps")
            scratch.drop("live")
            several = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
            own = scratch.table(own.join(several, "key"), "several")
            scratch.drop("comps")
            most = own.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"))
            rest = own.join(most, "key").filter("comp <> top").select("key", F.col("at").alias("ata"), F.col("digest").alias("x"), F.col("n").alias("na"), F.col("comp").alias("comp0"))
            pairs = rest.join(own.select("key", F.col("at").alias("atb"), F.col("digest").alias("y"), F.col("n").alias("nb"), "comp"), "key").filter(F.col("comp") != F.col("comp0")).filter(_room(percent))
        if not k:
            pairs = pairs.select("x", "na", "y", "nb").unionByName(near)
        pairs = pairs.filter(_fit(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = scratch.table(_possible(pairs, reps, percent), f"pairs{k}")
        ends = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
        needed = spark.sparkContext.broadcast(_bitmap(reps.join(ends, "digest").select(F.col("rep.h1").alias("key")), BITMAP_BITS - 2))
        sets = scratch.table(_sets(docs, id_col, text_col, needed), f"sets{k}")
        found = scratch.table(_verified(pairs, sets, percent), f"links{k}")
        scratch.drop(f"pairs{k}", f"sets{k}")
        needed.destroy()
        links = found if links is None else links.unionByName(found)
        inner = Scratch(spark, "near-groups")
        groups = inner.close(scratch.table(connected_components(links, inner, "a", "b"), f"groups{k}"))
    at = reps.select("digest", "rep").join(groups.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "rep", F.coalesce("component", "digest").alias("comp"))
    low = at.groupBy("comp").agg(F.min("rep").alias("keep"))
    return sig.select("id", "h1", "h2", "digest"), at.join(low, "comp").select("digest", "keep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``(id, component_id)`` of every row; component_id is the smallest id reachable over links."""
    scratch = Scratch(docs.sparkSession, "near", BATCH)
    rows, whose = _groups(docs, scratch, id_col, text_col, percent)
    return scratch.close(rows.join(whose, "digest").select(F.col("id").alias(id_col), F.col("keep.id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each group left."""
    scratch = Scratch(docs.sparkSession, "near", BATCH)
    _, whose = _groups(docs, scratch, id_col, text_col, percent)
    kept = scratch.table(whose.select("keep.h1", "keep.h2").distinct(), "kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_row_key(id_col, text_col))
    # repeated rows fold before the shuffle; the join then finds them by the same key
    rows = rows.groupBy("h1", "h2").agg(F.first("row").alias("row"))
    return scratch.close(rows.join(kept, ["h1", "h2"], "left_semi").select("row.*"))
