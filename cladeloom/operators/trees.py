"""Tables of tree nodes and splits, tree distance and rerooting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trees

NODES = "node_id int, parent_id int, name string, length double, support double, tips array<string>, last int"


def nodes(table: DataFrame, tree_id: str = "tree_id", newick: str = "newick") -> DataFrame:
    """One row per node, in pre-order from 0.  Null or blank trees have none."""
    kind = table.schema[tree_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [tree_id, *(x.split()[0] for x in NODES.split(", "))]
        for frame in frames:
            rows = [(key, *r) for key, text in zip(frame[tree_id], frame[newick]) if isinstance(text, str) and text.strip() for r in trees.node_rows(trees.parse(text))]
            yield pd.DataFrame(rows, columns=columns).astype({"parent_id": "Int32"})

    return table.select(tree_id, newick).mapInPandas(run, f"`{tree_id}` {kind}, {NODES}")


def tips_per_tree(table: DataFrame, tree_id: str = "tree_id") -> DataFrame:
    """``(tree_id, n_tips, n_species)``; a tip's species is its name without the last ``_part``."""
    tips = nodes(table, tree_id).filter(F.size("tips") == 1).groupBy(tree_id, "name").agg(F.count("*").alias("n"))
    return tips.groupBy(tree_id).agg(F.sum("n").alias("n_tips"), F.countDistinct(F.regexp_replace("name", "_[^_]*$", "")).alias("n_species"))


def clade_scores(node_table: DataFrame, wanted: DataFrame, total: int, tree_id: str = "tree_id") -> DataFrame:
    """``(tree_id, node_id, score)`` of non-root nodes against the one set of ``wanted`` tips.

    ``wanted`` (column ``tip``) is a side of the reference's root; it is joined tip by tip, so no
    node meets the whole set.
    """
    inner = node_table.filter("parent_id is not null")
    n = wanted.count()
    tips = inner.select(tree_id, "node_id", F.size("tips").alias("own"), F.explode("tips").alias("tip"))
    met = tips.join(wanted.select("tip", F.lit(1).alias("_hit")), "tip", "left").groupBy(tree_id, "node_id", "own").agg(F.count("_hit").alias("shared"))
    return met.select(tree_id, "node_id", (F.lit(total - n) - F.col("own") + 2 * F.col("shared")).cast("long").alias("score"))


def reroot_choice(scores: DataFrame, tree_id: str = "tree_id") -> DataFrame:
    """The first node in pre-order with the greatest score above 0."""
    best = scores.filter("score > 0").groupBy(tree_id).agg(F.max(F.struct("score", (-F.col("node_id")).alias("k"))).alias("b"))
    return best.select(tree_id, (-F.col("b.k")).alias("node_id"), F.col("b.score").alias("score"))


def splits(node_table: DataFrame, tree_id: str = "tree_id") -> DataFrame:
    """``(tree_id, split)``: distinct non-trivial splits, as the sorted side without the first tip."""
    whole = node_table.filter("parent_id is null").select(tree_id, F.array_sort("tips").alias("every"))
    sides = node_table.filter("parent_id is not null").join(whole, tree_id)
    side = F.when(F.array_contains("tips", F.col("every")[0]), F.array_except("every", "tips")).otherwise(F.array_sort("tips"))
    sides = sides.select(tree_id, side.alias("s"), F.size("every").alias("n")).filter((F.size("s") >= 2) & (F.size("s") <= F.col("n") - 2))
    return sides.select(tree_id, F.array_join("s", ",").alias("split")).distinct()


def robinson_foulds(split_table: DataFrame, reference: DataFrame, tree_id: str = "tree_id") -> DataFrame:
    """``(tree_id, rf, norm_rf)`` against the one reference (column ``split``)."""
    total = reference.count()
    met = split_table.join(reference.select("split", F.lit(1).alias("_hit")), "split", "left").groupBy(tree_id).agg(F.count("*").alias("own"), F.count("_hit").alias("shared"))
    rf = F.col("own") + total - 2 * F.col("shared")
    return met.select(tree_id, rf.alias("rf"), F.round(rf.cast("double") / (F.col("own") + total), 9).alias("norm_rf"))
