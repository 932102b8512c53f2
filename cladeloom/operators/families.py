"""Statistics and gates over hits and gene families."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def genes_per_species(hits: DataFrame) -> DataFrame:
    return hits.groupBy("species").agg(F.countDistinct("gene_id").alias("num_genes"))


def homologs(hits: DataFrame) -> DataFrame:
    """Species with a raw hit, per gene."""
    return hits.groupBy("gene_id").agg(F.countDistinct("species").alias("num_species"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def duplicity(members: DataFrame, hits: DataFrame) -> DataFrame:
    """Kept members over species with a raw hit, per gene; may be below 1."""
    kept = members.groupBy("gene_id").agg(F.count("*").alias("members"))
    return kept.join(homologs(hits), "gene_id").select("gene_id", F.round(F.col("members").cast("double") / F.col("num_species"), 9).alias("duplicity"))


def gene_lists(hits: DataFrame) -> DataFrame:
    """``(species, gene_id, n_hits, hit_list)``: a species' hits on a gene, in file order."""
    item = F.struct("line_no", "score", "pos")
    text = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.concat(F.lit("("), F.concat_ws(",", s["score"], s["line_no"], s["pos"]), F.lit(")")))
    return hits.groupBy("species", "gene_id").agg(F.count("*").alias("n_hits"), F.array_join(text, ";").alias("hit_list"))


def passing_genes(members: DataFrame, min_species: int) -> DataFrame:
    return members.groupBy("gene_id").agg(F.countDistinct("species").alias("n")).filter(F.col("n") >= min_species).select("gene_id")


def with_min_species(members: DataFrame, min_species: int) -> DataFrame:
    return members.join(passing_genes(members, min_species), "gene_id", "left_semi")


def filtered_genes(members: DataFrame, min_species: int) -> DataFrame:
    return members.select("gene_id").distinct().join(passing_genes(members, min_species), "gene_id", "left_anti")


def gene_tree_count(members: DataFrame, min_species: int) -> DataFrame:
    return passing_genes(members, min_species).agg(F.count("*").alias("num_gt"))


def padded(members: DataFrame, gene_count: int) -> DataFrame:
    """Every id from 1 to ``gene_count`` with its member count; genes without members have 0."""
    ids = members.sparkSession.range(1, gene_count + 1).select(F.col("id").cast("int").alias("gene_id"))
    n = members.groupBy("gene_id").agg(F.count("*").alias("n"))
    return ids.join(n, "gene_id", "left").select("gene_id", F.coalesce("n", F.lit(0)).alias("members"))


def lengths(members: DataFrame, seq: str = "seq") -> DataFrame:
    """``(gene_id, n_seq, mean_len)``; the mean is rounded up."""
    n, total = F.count("*"), F.sum(F.length(seq).cast("long"))
    return members.groupBy("gene_id").agg(n.alias("n_seq"), F.expr(f"(sum(cast(length({seq}) as bigint)) + count(*) - 1) div count(*)").alias("mean_len"))


def alignment_gate(members: DataFrame, more_than: int, length: int) -> DataFrame:
    """Genes to align: more than ``more_than`` sequences, or a mean above one and a half lengths."""
    return lengths(members).filter((F.col("n_seq") > more_than) | (F.col("mean_len") > int(1.5 * length)))


def tree_gate(aligned: DataFrame, more_than: int, length: int, identity: int, seq: str = "seq") -> DataFrame:
    """Genes to build a tree of: enough rows and an alignment that isn't blown up."""
    return lengths(aligned, seq).filter((F.col("n_seq") > more_than) & (F.col("mean_len") < 100 * length // identity))


def identical_genes(members: DataFrame) -> DataFrame:
    """Genes whose sequences are all equal, ignoring case: their own alignment."""
    return members.groupBy("gene_id").agg(F.countDistinct(F.upper("seq")).alias("n_distinct")).filter("n_distinct = 1").select("gene_id")


def density_bins(values: DataFrame, value: str, step: float) -> DataFrame:
    """``(bin, weight, n, total, squares)``: each value is split over the two lattice points beside it, the
    nearer one taking more; with the moments of the values at the lower one.  A value on a lattice point is
    at that one alone, and a point that no value gives any weight is no bin.

    Bins add up, so parts of a table can be binned apart and merged; there are as many as the values'
    range has steps.  Nulls do not count.
    """
    x = F.col(value).cast("double")
    low = F.floor(x / step)
    right = x / step - low
    rows = values.filter(x.isNotNull()).groupBy(low.cast("long").alias("low")).agg(F.count("*").alias("n"), F.sum(right).alias("right"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))
    none = [F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("squares")]
    lower = rows.select(F.col("low").alias("bin"), (F.col("n") - F.col("right")).alias("weight"), "n", "total", "squares")
    upper = rows.select((F.col("low") + 1).alias("bin"), F.col("right").alias("weight"), *none)
    return lower.unionByName(upper).groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("weight", "n", "total", "squares"))).filter("weight > 0 OR n > 0")


def density(bins: DataFrame, step: float, points: int = 200, cut: float = 3.0) -> DataFrame:
    """``(x, density)``: a Gaussian kernel density of binned values at ``points`` places, from ``cut``
    bandwidths below the lowest bin to as far above the highest.

    The bandwidth is the standard deviation times ``n ** -0.2``.  No rows for fewer than two values or
    equal ones.  The bins come together in one row.
    """
    one = bins.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.array_sort(F.collect_list(F.struct("bin", "weight"))).alias("own"))
    variance = (F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / (F.col("n") - 1)
    one = one.filter("n > 1").withColumn("v", variance).filter("v > 1e-12").withColumn("h", F.sqrt("v") * F.pow("n", F.lit(-0.2)))
    first, last = F.col("lo") * step - cut * F.col("h"), F.col("hi") * step + cut * F.col("h")
    rows = one.select("n", "h", "own", first.alias("first"), ((last - first) / (points - 1)).alias("gap"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    at = F.col("first") + F.col("k") * F.col("gap")
    kernel = lambda z: F.exp(-z * z / 2)
    total = F.aggregate("own", F.lit(0.0), lambda acc, b: acc + b["weight"] * kernel((at - b["bin"] * step) / F.col("h")))
    return rows.select(at.alias("x"), (total / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
