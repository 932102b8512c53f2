"""k-mer profiles, set similarity and the seed stage of the similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from . import chunks
from .seeds import TURNED, Slab, bands, base_sets, matches, rolled, slabs, words

PIECE = 512
#: words that a task holds before it hands them on
HELD = 1 << 24
PARTS = 8  # bits


def _spread(df: DataFrame) -> DataFrame:
    """Explosions multiply rows: deal small inputs over all slots first."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def positions(rows: DataFrame, k: int, seq: str = "seq", start: str | None = None, own: str | None = None, pos: str = "pos", step: int = 1) -> DataFrame:
    """One row per k-mer: the other columns of ``rows``, ``pos`` and ``kmer`` (upper case).

    A row's bases are cut into pieces, one row each, before the k-mers of a piece are listed, so
    nothing is held that grows with the length of a record.  ``start`` is added to positions; only
    k-mers that begin in the first ``own`` bases count.
    """
    rest = [c for c in rows.columns if c not in (seq, start, own)]
    bytes_ = F.upper(F.col(seq)).cast("binary")
    n = F.octet_length(F.col(seq)) - (k - 1)
    n = n if own is None else F.least(n, F.col(own).cast("int"))
    base = F.lit(0).cast("long") if start is None else F.col(start).cast("long")
    cut = rows.select(*rest, bytes_.alias("_b"), n.alias("_n"), base.alias("_base")).filter("_n > 0")
    cut = cut.select(*rest, "_b", "_n", "_base", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(PIECE))).alias("_at"))
    piece = F.substring("_b", F.col("_at") + 1, F.least(F.lit(PIECE), F.col("_n") - F.col("_at")) + (k - 1)).cast("string")
    cut = cut.select(*rest, (F.col("_base") + F.col("_at")).alias("_at"), piece.alias("_piece"))
    listed = F.transform(F.sequence(F.lit(1), F.length("_piece") - (k - 1)), lambda i: F.substring(F.col("_piece"), i, F.lit(k)))
    out = cut.select(*rest, "_at", F.posexplode(listed).alias("_i", "kmer")).select(*rest, (F.col("_at") + F.col("_i")).alias(pos), "kmer")
    return out if step == 1 else out.filter(F.col(pos) % step == 0)


def _in_genome(genome: DataFrame, k: int, *keep: str, pos: str = "pos") -> DataFrame:
    c = chunks.chunked(genome, k)
    return positions(_spread(c).select(*keep, "start", "own", "seq"), k, start="start", own="own", pos=pos)


def profile(genome: DataFrame, k: int, by: str = "species") -> DataFrame:
    """``(by, n_kmers, n_distinct)`` over plain, upper-cased k-mers.

    Up to 31 bases, a task hands on the words that it met, each once, as sorted numbers in parts of a
    group; a part's distinct words are counted together.  Longer k-mers are counted as rows.
    """
    if k <= 31:
        return _profile(genome, k, by)
    rows = _in_genome(genome, k, by).filter(dna.is_plain(F.col("kmer")))
    once = rows.groupBy(by, dna.packed(F.col("kmer"), k).alias("kmer")).agg(F.count("*").alias("n"))
    return once.groupBy(by).agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_distinct"))


# A fixed value: plain bases, and 4 for all else.
_PLAIN = np.full(256, 4, np.uint8)
for _k, _c in enumerate("ACGT"):
    _PLAIN[ord(_c)] = _PLAIN[ord(_c.lower())] = _k

_ODD = 0x9E3779B97F4A7C15


def _slab_words(slab: Slab, k: int) -> np.ndarray:
    """The words of a slab's plain k-mers, those that begin in a chunk's own bases, multiplied by an odd
    number, which keeps them apart and spreads them over all numbers of as many bits."""
    n = len(slab.sets) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    step = np.zeros(len(slab.sets) + 1, np.int8)
    own = np.clip(np.minimum(slab.own, slab.length - k + 1), 0, None)
    np.add.at(step, slab.at, 1)
    np.add.at(step, slab.at + own, -1)
    good = np.cumsum(step[:n], dtype=np.int8) > 0
    other = np.flatnonzero(slab.sets > 3)
    for j in range(k) if len(other) else ():
        at = other - j
        good[at[(at >= 0) & (at < n)]] = False
    word = rolled(slab.sets & 3, "1" * k)[good].astype(np.uint64)
    return (word * np.uint64(_ODD) & np.uint64((1 << 2 * k) - 1)).astype(np.int32 if k < 16 else np.int64)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    word = np.sort(np.concatenate(parts))
    return word[np.append(True, word[1:] != word[:-1])[: len(word)]]


def _profile(genome: DataFrame, k: int, by: str) -> DataFrame:
    own = _spread(chunks.chunked(genome, k).select(by, "start", "own", F.col("seq").cast("binary").alias("seq")))
    kind = own.schema[by].dataType.simpleString()
    low = max(0, 2 * k - PARTS)  # bits of a word within its part
    rest = np.uint16 if low <= 16 else np.uint32 if low <= 32 else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        count: dict = {}
        n = 0

        def rows(of: pa.DataType) -> Iterator[pa.RecordBatch]:
            for group, (word,) in held.items():
                cut = np.searchsorted(word, np.arange((1 << 2 * k - low) + 1, dtype=np.int64) << low)
                used = np.flatnonzero(np.diff(cut))
                inside = (word & ((1 << low) - 1)).astype(rest)
                blobs = [inside[cut[p] : cut[p + 1]].tobytes() for p in used.tolist()]
                counts = [count[group]] + [0] * (len(used) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(used), of), pa.array(used, pa.int32()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=[by, "part", "n", "words"])

        for batch in batches:
            batch = batch.sort_by(by)
            group = batch.column(by).to_pylist()
            edges = [j for j in range(len(group)) if not j or group[j] != group[j - 1]] + [len(group)]
            for a, b in zip(edges, edges[1:]):
                found = np.concatenate([_slab_words(slab, k) for _, slab in slabs(batch.slice(a, b - a), _PLAIN)])
                if len(found):
                    count[group[a]] = count.get(group[a], 0) + len(found)
                    held.setdefault(group[a], []).append(_distinct([found]))
                    n += len(held[group[a]][-1])
            if n > HELD:
                held = {g: [_distinct(x)] for g, x in held.items()}
                n = sum(len(x) for (x,) in held.values())
                if n > HELD // 2:
                    yield from rows(batch.column(by).type)
                    held, count, n = {}, {}, 0
        if held:
            held = {g: [_distinct(x)] for g, x in held.items()}
            yield from rows(batch.column(by).type)

    def distinct(table: pa.Table) -> pa.Table:
        word = _distinct([np.frombuffer(x, rest) for x in table.column("words").to_pylist()])
        return pa.table([table.column(by).slice(0, 1), pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([len(word)], pa.int64())], names=[by, "n", "n_distinct"])

    parts = own.mapInArrow(run, f"`{by}` {kind}, part int, n long, words binary")
    counted = parts.groupBy(by, "part").applyInArrow(distinct, f"`{by}` {kind}, n long, n_distinct long")
    return counted.groupBy(by).agg(F.sum("n").alias("n_kmers"), F.sum("n_distinct").alias("n_distinct"))


def jaccard(members: DataFrame, k: int, group: str = "gene_id", taxon: str = "taxon") -> DataFrame:
    """``(group, a, b, shared, jaccard)`` for pairs of a group's taxa that share a k-mer, a < b.

    Sets meet by an equi-join on (group, k-mer).  Groups are gene families, capped by the number of
    species times the copies kept.
    """
    sets = members.select(group, taxon, F.explode(F.array_distinct(dna.kmers(F.upper("seq"), k))).alias("kmer"))
    size = sets.groupBy(group, taxon).agg(F.count("*").alias("n"))
    left, right = sets.withColumnRenamed(taxon, "a"), sets.withColumnRenamed(taxon, "b")
    shared = left.join(right, [group, "kmer"]).filter("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(size.select(group, F.col(taxon).alias("a"), F.col("n").alias("na")), [group, "a"]).join(size.select(group, F.col(taxon).alias("b"), F.col("n").alias("nb")), [group, "b"])
    return out.select(group, "a", "b", "shared", F.round(F.col("shared").cast("double") / (F.col("na") + F.col("nb") - F.col("shared")), 9).alias("jaccard"))


def sketches(genome: DataFrame, k: int, size: int = 1000, by: str = "species") -> DataFrame:
    """``(by, sketch)``: the ``size`` smallest hashes of a group's distinct canonical k-mers, ascending.

    A k-mer and its reverse complement are one.  Sketches merge: that of several chunks is the smallest
    of theirs together, so a task sends one of at most ``size`` numbers a group, whatever it read.
    k-mers with ambiguity codes don't count; a group without k-mers has no row.
    """
    chunked = _spread(chunks.chunked(genome, k).select(by, "own", F.col("seq").cast("binary").alias("seq")))
    kind = chunked.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for group, own, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = sketch_of(seq.as_py(), k, size, own)
                held[group] = np.unique(np.concatenate([held[group], found]))[:size] if group in held else found
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), batch.column(0).type), pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))], names=[by, "part"])

    parts = chunked.mapInArrow(run, f"`{by}` {kind}, part array<long>")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("part")))), 1, size)
    return parts.groupBy(by).agg(merged.alias("sketch")).filter(F.size("sketch") > 0)


def row_sketches(rows: DataFrame, k: int, size: int = 1000, seq: str = "seq") -> DataFrame:
    """The other columns of ``rows`` and the ``sketch`` of each row's short sequence; rows without k-mers go."""
    rest = [f for f in rows.schema if f.name != seq]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch_of(x or b"", k, size).tolist() for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], names=[*(f.name for f in rest), "sketch"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "sketch array<long>"])
    return rows.select(*(f.name for f in rest), F.col(seq).cast("binary")).mapInArrow(run, schema).filter(F.size("sketch") > 0)


# Odd multipliers of a published 64-bit mix.
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def sketch_of(seq: bytes, k: int, size: int, own: int | None = None) -> np.ndarray:
    """The smallest hashes, 63 bits each, of the canonical k-mers that begin in the first ``own`` bases."""
    sets = base_sets(seq if own is None else seq[: own + k - 1])
    at, word = words(sets, "1" * k)
    turned = np.zeros(max(0, len(sets) - k + 1), np.int64)
    back, other = words(TURNED[sets[::-1]], "1" * k)
    turned[len(turned) - 1 - back] = other
    x = np.minimum(word, turned[at]).view(np.uint64)
    for factor in _MIX:
        x = x * factor
        x ^= x >> np.uint64(32)
    return np.unique((x >> np.uint64(1)).view(np.int64))[:size]


def sketch_similarity(a: Column, b: Column, size: int = 1000) -> Column:
    """The estimated Jaccard index of two sketches: the share of their union's smallest hashes that both have."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) > 0, F.round(both.cast("double") / F.size(union), 9))


def sketch_pairs(table: DataFrame, by: str = "species", within: str | None = None, size: int = 1000) -> DataFrame:
    """``(within, a, b, jaccard)`` of every two sketches, of a group if ``within`` names one, a < b.

    Groups are genomes, or the members of a gene, of which there are at most species times copies.
    """
    group = [within] if within else []
    left, right = (table.select(*group, F.col(by).alias(n), F.col("sketch").alias(f"s{n}")) for n in "ab")
    met = left.join(right, [*group] or F.lit(True)).filter("a < b")
    return met.select(*group, "a", "b", sketch_similarity(F.col("sa"), F.col("sb"), size).alias("jaccard"))


def mash_distance(pairs: DataFrame, k: int) -> DataFrame:
    """Adds ``distance``: -ln(2 j / (1 + j)) / k; 0 at j = 1."""
    j = F.col("jaccard")
    d = -F.log(2 * j / (1 + j)) / k
    return pairs.filter(j > 0).withColumn("distance", F.round(F.abs(d), 9))


def seeds(genes: DataFrame, genome: DataFrame, k: int, step: int = 1, transitions: bool = False) -> DataFrame:
    """``(gene_id, strand, q_pos, species, rec, t_pos)``: k-mer matches on both strands, up to 31 bases.

    Every base counts and ambiguity codes match none; see ``seeds.matches``, which has patterns and codes.
    """
    return matches(genes, genome, "1" * k, step, transitions)


def seed_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("gene_id", "species").agg(F.count("*").alias("seeds"), F.countDistinct("rec").alias("records"))


def seed_bands(genes: DataFrame, genome: DataFrame, k: int, step: int = 1, transitions: bool = False, band: int = 32, least: int = 2, overlapping: bool = False) -> DataFrame:
    """``diagonals`` of ``seeds``, counted where the seeds are found."""
    parts = bands(genes, genome, "1" * k, step, transitions, width=band, overlapping=overlapping)
    return (
        parts.groupBy("gene_id", "species", "rec", "strand", "diagonal")
        .agg(F.sum("seeds").alias("seeds"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
        .filter(F.col("seeds") >= least)
    )


def diagonals(found: DataFrame, band: int = 32, least: int = 2, overlapping: bool = False) -> DataFrame:
    """Bands of diagonals with at least ``least`` seeds: candidates for extension.

    With ``overlapping``, a band begins every half band (``diagonal`` counts half bands), so seeds up
    to half a band apart always share one.
    """
    step = band // 2 if overlapping else band
    d = F.floor((F.col("t_pos") - F.col("q_pos")) / step).cast("long")
    rows = found.withColumn("diagonal", F.explode(F.array(d - 1, d)) if overlapping else d)
    return (
        rows.groupBy("gene_id", "species", "rec", "strand", "diagonal")
        .agg(F.count("*").alias("seeds"), F.min("t_pos").alias("t_start"), F.max("t_pos").alias("t_end"))
        .filter(F.col("seeds") >= least)
    )
