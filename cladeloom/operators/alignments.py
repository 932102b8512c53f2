"""Filters over aligned rows and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def site_occupancy(aligned: DataFrame, seq: str = "aligned") -> DataFrame:
    """``(gene_id, site, n_rows, filled)``: how many rows of a gene have a base at a site."""
    rows = aligned.select("gene_id", F.posexplode(F.split(seq, "")).alias("site", "base")).filter("base <> ''")
    return rows.groupBy("gene_id", "site").agg(F.count("*").alias("n_rows"), F.count_if(F.col("base") != "-").alias("filled"))


def masked_sites(aligned: DataFrame, least: float, seq: str = "aligned") -> DataFrame:
    """Sites with a lower share of bases than ``least``."""
    return site_occupancy(aligned, seq).filter(F.col("filled").cast("double") / F.col("n_rows") < least).select("gene_id", "site")


def mask_sites(aligned: DataFrame, least: float, seq: str = "aligned") -> DataFrame:
    """Rows without the masked sites.  The list of masked sites is one per gene."""
    drop = masked_sites(aligned, least, seq).groupBy("gene_id").agg(F.collect_set("site").alias("_drop"))
    rows = aligned.join(drop, "gene_id", "left")
    keep = F.array_except(F.sequence(F.lit(0), F.length(seq) - 1), F.coalesce("_drop", F.expr("cast(array() as array<int>)")))
    # the letters are bound once, as a lambda's variable
    row = F.transform(F.array(F.split(seq, "")), lambda letters: F.array_join(F.transform(keep, lambda i: F.get(letters, i)), ""))[0]
    out = F.when(F.length(seq) > 0, row).otherwise(F.col(seq))
    return rows.withColumn(seq, out).drop("_drop")


def filter_fragments(aligned: DataFrame, least: float, seq: str = "aligned") -> DataFrame:
    """Rows with at least ``least`` of their columns filled."""
    bases = F.length(F.replace(F.col(seq), F.lit("-"), F.lit("")))
    return aligned.filter(bases.cast("double") / F.length(seq) >= least)


def pair_measures(pairs: DataFrame, a: str = "a", b: str = "b", gene_length: str = "gene_length") -> DataFrame:
    """Adds identity, coverage and continuity of an aligned pair, in percent.

    identity: matches over matches and mismatches; coverage: bases of ``a`` aligned over the
    gene's length; continuity: columns without a gap over all columns.
    """
    both = F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    out = pairs.withColumn("_z", F.filter(both, lambda s: (s["x"] != "") & (s["y"] != "")))
    solid = F.size(F.filter("_z", lambda s: (s["x"] != "-") & (s["y"] != "-"))).cast("double")
    same = F.size(F.filter("_z", lambda s: (s["x"] == s["y"]) & (s["x"] != "-"))).cast("double")
    percent = lambda n, d: F.round(F.when(d > 0, 100 * n / d), 6)
    return out.select(*(c for c in pairs.columns), percent(same, solid).alias("identity"), percent(solid, F.col(gene_length)).alias("coverage"), percent(solid, F.size("_z")).alias("continuity"))


def pair_filter(pairs: DataFrame, identity: float = 65, coverage: float = 85, continuity: float = 85) -> DataFrame:
    return pair_measures(pairs).filter((F.col("identity") >= identity) & (F.col("coverage") >= coverage) & (F.col("continuity") >= continuity))
