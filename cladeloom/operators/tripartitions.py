"""Gene trees with several copies a species as a table of speciations.

A gene tree is rooted where the fewest nodes are duplications: nodes below two of whose sides a species
stands.  At a duplication all children but the largest are cut off, so each tree falls into parts in
which a species has one copy and every node is a speciation; quartets are counted at these only, and no
quartet of paralogues is.  A speciation is the species on its sides: ``parts``, a sorted list of sorted
lists.  Equal ones add up, so the table of a round can be merged with that of the rounds before.

Every step is over arrays of a tree's tips.  A tree has as many nodes as copies, so its groups are small
however many trees there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = "parts array<array<string>>, n long"


def species(tip: Column) -> Column:
    """A tip's name without its last part, which numbers the copy."""
    return F.regexp_replace(tip, "_[^_]*$", "")


def _kinds(tips: Column) -> Column:
    return F.array_distinct(F.transform(tips, species))


def sides(nodes: DataFrame, tree_id: str = "tree_id") -> DataFrame:
    """``(tree, node_id, sides)``: for inner nodes of the unrooted tree, what hangs on each branch.

    A side is ``(at, tips, kinds)``: the child's node number, or -1 for the side above, its tips and
    their species.
    """
    kinds = lambda tips: _kinds(tips).alias("kinds")
    n = nodes.select(F.col(tree_id).alias("tree"), "node_id", "parent_id", "tips")
    every = n.filter("node_id = 0").select("tree", F.col("tips").alias("all"))
    below = n.filter("parent_id is not null").select("tree", F.col("parent_id").alias("node_id"), F.struct(F.col("node_id").alias("at"), "tips", kinds(F.col("tips"))).alias("side"))
    above = n.filter("node_id > 0").join(every, "tree").withColumn("rest", F.array_except("all", "tips"))
    above = above.select("tree", "node_id", F.struct(F.lit(-1).alias("at"), F.col("rest").alias("tips"), kinds(F.col("rest"))).alias("side"))
    return below.unionByName(above).groupBy("tree", "node_id").agg(F.sort_array(F.collect_list("side")).alias("sides")).filter(F.size("sides") > 1)


def _clash(kept: Column) -> Column:
    """Whether a species stands on two of the sides."""
    total = F.aggregate(kept, F.lit(0), lambda n, s: n + F.size(s["kinds"]))
    return total > F.size(F.array_distinct(F.flatten(F.transform(kept, lambda s: s["kinds"]))))


def _others(at: Column) -> Column:
    return F.filter("sides", lambda s: s["at"] != at)


def rooted(nodes: DataFrame, tree_id: str = "tree_id") -> tuple[DataFrame, DataFrame]:
    """The sides, with ``towards``: the side that the root is on; and ``(tree, root, duplications)``: the
    node above which the root is put.

    The root goes where the fewest nodes, itself included, are duplications, then where its smaller side
    is largest, then to the first.  A branch's number comes from that of its parent: running sums in
    pre-order, within a tree.
    """
    table = sides(nodes, tree_id)
    down = lambda at: _clash(_others(at)).cast("int")  # noqa: E731  # a duplication, if the root is on side ``at``
    own = table.select("tree", "node_id", "sides", F.when(F.exists("sides", lambda s: s["at"] == -1), down(F.lit(-1))).otherwise(0).alias("up"))
    total = own.groupBy("tree").agg(F.sum("up").alias("total"))
    step = own.select("tree", "up", F.explode(F.filter("sides", lambda s: s["at"] >= 0)).alias("s"), "sides")
    step = step.select("tree", F.col("s.at").alias("node_id"), (down(F.col("s.at")) - F.col("up")).alias("x"))
    n = nodes.select(F.col(tree_id).alias("tree"), "node_id", "parent_id", "tips", "last")
    branch = n.filter("node_id > 0").join(step, ["tree", "node_id"])
    events = branch.select("tree", F.col("node_id").alias("place"), F.lit(0).alias("end"), "x").unionByName(branch.select("tree", (F.col("last") + 1).alias("place"), F.lit(1).alias("end"), (-F.col("x")).alias("x")))
    run = Window.partitionBy("tree").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    sums = events.withColumn("path", F.sum("x").over(run)).filter("end = 0").select("tree", F.col("place").alias("node_id"), "path")
    every = n.filter("node_id = 0").select("tree", F.col("tips").alias("all"))
    at = branch.join(every, "tree").join(sums, ["tree", "node_id"]).join(total, "tree")
    here, there = _kinds(F.col("tips")), _kinds(F.array_except("all", "tips"))
    cost = F.col("total") + F.col("path") + F.arrays_overlap(here, there).cast("int")
    best = at.groupBy("tree").agg(F.min(F.struct(cost.alias("cost"), (-F.least(F.size(here), F.size(there))).alias("even"), "node_id", "last")).alias("b"))
    roots = best.select("tree", F.col("b.node_id").alias("root"), F.col("b.cost").cast("int").alias("duplications"))
    spans = n.select("tree", F.col("node_id").alias("at"), F.col("last").alias("end"))
    way = own.join(roots, "tree").select("tree", "node_id", "root", F.explode(F.transform("sides", lambda s: s["at"])).alias("at")).join(spans, ["tree", "at"])
    way = way.filter("at <= root AND root <= end").select("tree", "node_id", F.col("at").alias("towards"))
    return own.join(way, ["tree", "node_id"], "left").select("tree", "node_id", "sides", F.coalesce("towards", F.lit(-1)).alias("towards")), roots


def tagged(nodes: DataFrame, tree_id: str = "tree_id") -> DataFrame:
    """``(tree, node_id, duplication)`` of the inner nodes, as rooted by ``rooted``."""
    table, _ = rooted(nodes, tree_id)
    return table.select("tree", "node_id", _clash(_others(F.col("towards"))).alias("duplication"))


def speciations(nodes: DataFrame, tree_id: str = "tree_id") -> DataFrame:
    """``(parts, n)``: the speciations of all trees and how often each is met; those of fewer than four
    species tell nothing and are left out.  ``nodes`` is read several times."""
    table, roots = rooted(nodes, tree_id)
    kept = _others(F.col("towards"))
    # the largest child stays, the first of equals
    largest = F.array_max(F.transform(kept, lambda s: F.struct(F.size(s["tips"]).alias("n"), (-s["at"]).alias("at"))))["at"]
    cut = table.filter(_clash(kept)).select("tree", F.explode(F.filter(kept, lambda s: -s["at"] != largest)).alias("s")).select("tree", "s.tips")
    n = nodes.select(F.col(tree_id).alias("tree"), "node_id", "tips")
    every = n.filter("node_id = 0").select("tree", F.col("tips").alias("all"))
    root = n.join(roots, "tree").filter("node_id = root").join(every, "tree").withColumn("rest", F.array_except("all", "tips"))
    clash = root.filter(F.arrays_overlap(_kinds(F.col("tips")), _kinds(F.col("rest"))))
    cut = cut.unionByName(clash.select("tree", F.when(F.size("tips") > F.size("rest"), F.col("rest")).otherwise(F.col("tips")).alias("tips")))
    # what is cut off is nested, so a tip's part is the smallest that holds it; the rest is one more
    cut = cut.unionByName(every.select("tree", F.col("all").alias("tips")))
    own = cut.select("tree", F.size("tips").alias("size"), F.array_min("tips").alias("first"), F.explode("tips").alias("tip"))
    part = own.groupBy("tree", "tip").agg(F.min(F.struct("size", "first")).alias("part")).groupBy("tree", "part").agg(F.collect_list("tip").alias("own"))
    met = table.join(part.filter(F.size("own") >= 4), "tree")
    parts = F.filter(F.transform("sides", lambda s: F.array_sort(_kinds(F.array_intersect(s["tips"], F.col("own"))))), lambda p: F.size(p) > 0)
    found = met.select(F.array_sort(parts).alias("parts")).filter((F.size("parts") > 2) & (F.size(F.flatten("parts")) > 3))
    return found.groupBy("parts").agg(F.count("*").alias("n"))


def merge(state: DataFrame, more: DataFrame) -> DataFrame:
    """Two tables of speciations as one."""
    return state.unionByName(more).groupBy("parts").agg(F.sum("n").alias("n"))
