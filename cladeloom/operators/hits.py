"""Ranking, spacing and selection of hits ``(species, gene_id, score, line_no, pos, strand, seq)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna

SPACING = 2000
KEYS = ("species", "gene_id")
ORDER = ("score", "line_no", "pos")


def ranked(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``rn``: the rank by score, line and position, all descending, within species and gene; hits of both
    strands at one place stand + first.

    With ``most``, only that many ranks stay, which Spark pushes below the shuffle as a group
    limit: a group never sends more than ``most`` rows from a task.
    """
    w = Window.partitionBy(*KEYS).orderBy(*(F.desc(c) for c in ORDER), *(c for c in ("strand",) if c in hits.columns))
    out = hits.withColumn("rn", F.row_number().over(w))
    return out if most is None else out.filter(F.col("rn") <= most)


def query_best(hits: DataFrame, max_dup: int) -> DataFrame:
    """The best ``2 * max_dup`` hits of each gene in each genome."""
    return ranked(hits, 2 * max_dup)


def _spaced(positions: Column, spacing: int) -> Column:
    """Positions kept by the greedy walk: each at least ``spacing`` from all kept before it."""
    far = lambda kept, p: ~F.exists(kept, lambda k: F.abs(p - k) < spacing)
    return F.aggregate(positions, F.expr("cast(array() as array<bigint>)"), lambda kept, p: F.when(far(kept, p), F.array_append(kept, p)).otherwise(kept))


def spacing_kept(hits: DataFrame, spacing: int = SPACING) -> DataFrame:
    """``(species, gene_id, kept)``: positions that survive non-maximum suppression, best first.

    The walk is a fold over the group's sorted list; the aligner's cap keeps lists short.
    """
    listed = hits.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*ORDER)), asc=False).alias("l"))
    return listed.select(*KEYS, _spaced(F.transform("l", lambda s: s["pos"].cast("long")), spacing).alias("kept"))


def selected(hits: DataFrame, max_dup: int, spacing: int = SPACING) -> DataFrame:
    """The first n ranks, n being how many positions survive spacing, at most ``max_dup``.

    Spacing decides the count only, as in the older tool; ``selected_spaced`` takes the spaced
    hits themselves.
    """
    n = spacing_kept(hits, spacing).select(*KEYS, F.least(F.size("kept"), F.lit(max_dup)).alias("n"))
    return ranked(hits, max_dup).join(n, list(KEYS)).filter("rn <= n").drop("n")


def selected_spaced(hits: DataFrame, max_dup: int, spacing: int = SPACING) -> DataFrame:
    """The first ``max_dup`` spaced hits; where several stand at a kept position, the best."""
    kept = spacing_kept(hits, spacing).select(*KEYS, F.explode(F.slice("kept", 1, max_dup)).alias("pos"))
    at = ranked(hits).join(kept, [*KEYS, "pos"])
    return at.withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS, "pos").orderBy("rn"))).filter("_k = 1").drop("_k").select(*hits.columns, "rn")


def oriented(hits: DataFrame) -> DataFrame:
    """Gaps removed, and the reverse complement on the minus strand."""
    bare = dna.ungapped(F.col("seq"))
    return hits.withColumn("seq", F.when(F.col("strand") == "-", dna.reverse_complement(bare)).otherwise(bare))


def plain_only(hits: DataFrame) -> DataFrame:
    """Hits with foreign letters go; they have used up their rank, so copy numbers have holes."""
    return hits.filter(dna.is_plain(F.col("seq")))


def family(hits: DataFrame, max_dup: int, spacing: int = SPACING) -> DataFrame:
    """``(gene_id, species, copy, seq)``: members of each gene's family; copies number from 0."""
    rows = plain_only(oriented(selected(hits, max_dup, spacing)))
    return rows.select("gene_id", "species", (F.col("rn") - 1).alias("copy"), "seq")


def copy_mapping(members: DataFrame) -> DataFrame:
    """``(taxon, species)``, distinct."""
    return members.select(F.concat_ws("_", "species", "copy").alias("taxon"), "species").distinct()
