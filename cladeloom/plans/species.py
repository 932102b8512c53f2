"""The species tree that agrees with most quartets of the speciations, and statistics of its branches.

The search is over clusters: the sides of all speciations, of which the most frequent ``CLUSTERS`` count;
those of a tree from the species' similarities and of that tree improved by interchanges; and with
``ALL_SUBSETS`` species or fewer every subset, so the result is then the best of all trees.  Clusters that
make up a third one are looked for over blocks in Spark, speciations weigh the triples in Spark, and
a cluster's best tree is put together from smaller ones by dynamic programming.

What comes to the driver is bounded by the clusters: their bits, the triples and one weight a triple, and a
number for each two species.  A quartet has one vote in each gene tree's part, at any number of
species.  An approximation of quartet summary programs, not an equal of any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quartets, trees
from ..functions.storage import settle
from ..operators import tripartitions
from ..operators.trees import nodes

CLUSTERS = 20_000
ALL_SUBSETS = 7
TRIPLES = 1 << 14
STATS = "line_no long, branch string, topology int, support double, quartets double, frequency double, effective_genes double, length double"


def speciations(gene_tree_table: DataFrame) -> DataFrame:
    """The state of a round: the speciations of its gene trees ``(gene_id, newick)``."""
    table = gene_tree_table.filter("newick is not null")
    return tripartitions.speciations(settle(nodes(table, "gene_id")), "gene_id")


def species_names(gene_tree_table: DataFrame) -> list[str]:
    tips = nodes(gene_tree_table.filter("newick is not null"), "gene_id").filter(F.size("tips") == 1)
    return sorted(r[0] for r in tips.select(tripartitions.species(F.col("name"))).distinct().collect())


def _parts(rows: list, at: dict[str, int]) -> np.ndarray:
    """(speciations, parts, species): which species each part has."""
    out = np.zeros((len(rows), max(map(len, rows)), len(at)), np.float32)
    for k, parts in enumerate(rows):
        for j, p in enumerate(parts):
            out[k, j, [at[x] for x in p]] = 1
    return out


def _blocks(batches: Iterator[pa.RecordBatch], at: dict[str, int], size: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            part = batch.slice(lo, size)
            yield _parts(part.column(0).to_pylist(), at), part.column(1).to_numpy().astype(float)


def similarities(state: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For two species, in how many of a speciation's pairs of parts with a third they stand together, and
    in how many they might: a share of agreement."""
    at = {n: k for k, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, all_ = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
        for parts, n in _blocks(batches, at):
            for j in range(parts.shape[1]):
                own = parts[:, j]
                rest = (parts.sum(axis=(1, 2)) - own.sum(axis=1)) * n
                both += (own * rest[:, None]).T @ own
            some = parts.sum(axis=1)
            all_ += (some * (n * some.sum(axis=1))[:, None]).T @ some
        i, j = np.nonzero(np.tril(all_, -1))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j]), pa.array(all_[i, j])], names=["i", "j", "x", "n"])

    rows = state.select("parts", "n").mapInArrow(run, "i long, j long, x double, n double").groupBy("i", "j").agg(F.sum("x"), F.sum("n")).collect()
    both, all_ = np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for i, j, x, n in rows:
        both[i, j] = both[j, i] = x
        all_[i, j] = all_[j, i] = n
    return both, all_


def start_tree(state: DataFrame, names: list[str]) -> trees.Node:
    """Neighbour joining on the species' disagreement; species that never meet are furthest apart."""
    both, all_ = similarities(state, names)
    with np.errstate(invalid="ignore", divide="ignore"):
        distance = np.where(all_ > 0, 1 - both / all_, 1.0)
    np.fill_diagonal(distance, 0)
    return trees.neighbour_joining(names, distance)


def branch_counts(state: DataFrame, names: list[str], own: list[quartets.Branch]) -> tuple[np.ndarray, np.ndarray]:
    """Per branch its quartets by pairing; and the effective number of gene trees for each: a tree's share
    of the quartets that its species could tell of.  Six numbers a branch come back."""
    at = {n: k for k, n in enumerate(names)}
    colours = np.zeros((4, len(own), len(names)), np.float32)
    for b, branch in enumerate(own):
        for side in range(4):
            colours[side, b, [at[n] for n in branch.sides[side]]] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, share = np.zeros((3, len(own))), np.zeros((3, len(own)))
        for parts, n in _blocks(batches, at, 64):
            met = np.einsum("sbt,kjt->skjb", colours, parts, optimize=True).astype(float)
            total = met.sum(axis=2, keepdims=True)
            could = np.maximum(total[:, :, 0].prod(axis=0), 1)
            for k, (p, q, r, s) in enumerate(quartets.PAIRINGS):
                # r and s stand together in one part, p and q in two others
                apart = (total[p] - met[p]) * (total[q] - met[q]) - ((met[p] * met[q]).sum(axis=1, keepdims=True) - met[p] * met[q])
                found = (met[r] * met[s] * apart).sum(axis=1)
                number[k] += n @ found
                share[k] += n @ (found / could)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), *map(pa.array, number), *map(pa.array, share)], names=["b", "n0", "n1", "n2", "z0", "z1", "z2"])

    cols = [f"{x}{k}" for x in "nz" for k in range(3)]
    found = state.select("parts", "n").mapInArrow(run, "b long, " + ", ".join(f"{c} double" for c in cols))
    rows = np.array(sorted(tuple(r) for r in found.groupBy("b").agg(*(F.sum(c) for c in cols)).collect())).reshape(-1, 7)
    if not len(rows):
        return np.zeros((len(own), 3)), np.zeros((len(own), 3))
    return np.round(rows[:, 1:4], 6), rows[:, 4:]


def _clusters_of(tree: trees.Node, at: dict[str, int]) -> set[int]:
    """The sides without the last species, as bits."""
    every, last = (1 << len(at)) - 1, 1 << len(at) - 1
    out = set()
    for row in trees.node_rows(tree):
        own = sum(1 << at[t] for t in row[5])
        out.add(every ^ own if own & last else own)
    return out - {0}


def clusters(state: DataFrame, names: list[str], given: list[trees.Node], most: int = CLUSTERS) -> list[int]:
    """Species sets without the last species, as bits, by size: sides of speciations and of the given trees."""
    at = {n: k for k, n in enumerate(names)}
    every, last = (1 << len(names)) - 1, 1 << len(names) - 1
    out = {1 << k for k in range(len(names) - 1)} | {every ^ last}
    if len(names) <= ALL_SUBSETS:
        return sorted(range(1, last), key=lambda c: (c.bit_count(), c))
    for tree in given:
        out |= _clusters_of(tree, at)
    side = state.select("n", F.array_distinct(F.flatten("parts")).alias("some"), F.explode("parts").alias("side"))
    # what the rest of the tree's species are is a side as well
    both = side.select("n", F.explode(F.array("side", F.array_sort(F.array_except("some", "side")))).alias("side")).filter(F.size("side") > 1)
    for row in both.groupBy("side").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "side").limit(most).collect():
        own = sum(1 << at[x] for x in row["side"])
        out.add(every ^ own if own & last else own)
    return sorted(out - {0}, key=lambda c: (c.bit_count(), c))


def _bits(own: list[int], n: int) -> np.ndarray:
    words = -(-n // 64)
    return np.frombuffer(b"".join(c.to_bytes(8 * words, "little") for c in own), "<u8").reshape(len(own), words)


def triples(spark, own: list[int], n: int) -> np.ndarray:
    """``(c, a, b)``, places in ``own``: a and b make up c, a no smaller than b.  Each task tests its
    clusters against all that could be the larger part."""
    bits, size, place = _bits(own, n), np.array([c.bit_count() for c in own]), {c: k for k, c in enumerate(own)}
    shared = spark.sparkContext.broadcast((own, bits, size, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits, size, place = shared.value
        for batch in batches:
            rows = []
            for c in batch.column(0).to_pylist():
                lo, hi = np.searchsorted(size, [-(-size[c] // 2), size[c]])
                inside = lo + np.flatnonzero(((bits[lo:hi] & ~bits[c]) == 0).all(axis=1))
                for a in inside.tolist():
                    b = place.get(own[c] ^ own[a])
                    if b is not None and (size[a] > size[b] or a < b):
                        rows.append((c, a, b))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [()] * 3)], names=["c", "a", "b"])

    found = spark.range(len(own)).repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "c long, a long, b long").toArrow()
    return np.stack([found.column(x).to_numpy() for x in "cab"], axis=1).astype(np.int64) if found.num_rows else np.zeros((0, 3), np.int64)


def weights(state: DataFrame, names: list[str], own: list[int], which: np.ndarray) -> np.ndarray:
    """Quartets that a node with sides a, b and the rest shares with the speciations, two of one side
    together and one of each other.  A quartet of the tree is met at two nodes."""
    at = {n: k for k, n in enumerate(names)}
    member = np.array([[c >> k & 1 for k in range(len(names))] for c in own], np.float32)
    shared = state.sparkSession.sparkContext.broadcast((member, which))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, which = shared.value
        total = np.zeros(len(which))
        for parts, n in _blocks(batches, at, 64):
            met = np.einsum("ct,kjt->cjk", member, parts, optimize=True)
            every = parts.sum(axis=2).T[None]
            for lo in range(0, len(which), TRIPLES):
                a, b = met[which[lo : lo + TRIPLES, 1]], met[which[lo : lo + TRIPLES, 2]]
                three = (a, b, every - a - b)
                for i in range(3):
                    r, p, q = three[i], three[i - 1], three[i - 2]
                    apart = (p.sum(axis=1, keepdims=True) - p) * (q.sum(axis=1, keepdims=True) - q) - ((p * q).sum(axis=1, keepdims=True) - p * q)
                    total[lo : lo + TRIPLES] += (r * (r - 1) / 2 * apart).sum(axis=1).astype(float) @ n
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where])], names=["t", "w"])

    found = state.select("parts", "n").mapInArrow(run, "t long, w double").groupBy("t").agg(F.sum("w").alias("w")).toArrow()
    out = np.zeros(len(which))
    out[found.column("t").to_numpy()] = found.column("w").to_numpy()
    return out


def best_tree(names: list[str], own: list[int], which: np.ndarray, weight: np.ndarray) -> tuple[trees.Node, float]:
    """The tree of clusters with the highest sum of weights, from the smallest clusters upwards; and its
    score in quartets."""
    score = np.full(len(own), -np.inf)
    choice: dict[int, tuple[int, int]] = {}
    for k, c in enumerate(own):
        if c.bit_count() == 1:
            score[k] = 0
    order = np.argsort(which[:, 0], kind="stable")  # clusters stand by size
    edge = np.flatnonzero(np.diff(which[order, 0], prepend=-1)).tolist()
    for lo, hi in zip(edge, [*edge[1:], len(order)]):
        rows = order[lo:hi]
        total = score[which[rows, 1]] + score[which[rows, 2]] + weight[rows]
        k = int(total.argmax())
        c, a, b = which[rows[k]].tolist()
        if total[k] > score[c]:
            score[c], choice[c] = total[k], (a, b)
    built: dict[int, trees.Node] = {}
    top = len(own) - 1
    todo, seen = [top], []
    while todo:  # children are built before their parents
        c = todo.pop()
        seen.append(c)
        todo += choice.get(c, ())
    for c in reversed(seen):
        built[c] = trees.Node(children=[built[a] for a in choice[c]]) if c in choice else trees.Node(names[own[c].bit_length() - 1])
    return trees.Node(children=[built[top], trees.Node(names[-1])]), float(score[top]) / 2


def search(state: DataFrame, names: list[str], most: int = CLUSTERS) -> tuple[trees.Node, float]:
    """The best tree over the clusters, and its quartets."""
    given = []
    if len(names) > ALL_SUBSETS:
        start = start_tree(state, names)
        given = [start, quartets.improve(start, lambda own: branch_counts(state, names, own)[0])]
    own = clusters(state, names, given, most)
    which = triples(state.sparkSession, own, len(names))
    return best_tree(names, own, which, weights(state, names, own, which))


def branch_length(z: float, n: float, lam: float = 0.5) -> float:
    """Coalescent units from the share of the tree's own pairing, as published: most probable under the
    coalescent, with a prior rate of ``2 * lam``; 0 where the share is no more than a third."""
    share = z / (n + 2 * lam) if n > 0 else 0.0
    return -math.log(1.5 * (1 - share)) if share > 1 / 3 else 0.0


def branch_rows(tree: trees.Node, state: DataFrame, names: list[str]) -> list[tuple]:
    """``STATS``: three rows a branch, the tree's own pairing first; supports and lengths are set on the tree.

    ``frequency`` is the pairing's share of the effective gene trees; ``length`` is the branch's length if
    the pairing were the tree's.
    """
    own = quartets.branches(tree)
    if not own:
        return []
    counts, effective = branch_counts(state, names, own)
    every, out = frozenset(names), []
    for b, (branch, count, z) in enumerate(zip(own, counts, effective)):
        n = float(z.sum())
        posterior = quartets.supports(z)
        branch.node.support, branch.node.length = posterior[0], branch_length(float(z[0]), n)
        side = branch.sides[0] | branch.sides[1]
        said = ",".join(sorted(min(side, every - side, key=lambda s: (len(s), sorted(s)))))
        for k in range(3):
            out.append((3 * b + k, said, k + 1, float(posterior[k]), float(count[k]), float(z[k]) / n if n else 0.0, n, branch_length(float(z[k]), n)))
    return out


def tree_and_stats(state: DataFrame, names: list[str]) -> tuple[trees.Node | None, list[tuple]]:
    """The species tree of the speciations ``state`` over ``names``, and its branches' ``STATS`` rows."""
    if len(names) < 2:
        return None, []
    if len(names) < 4:
        return trees.Node(children=[trees.Node(n) for n in names]), []
    # few bytes, much work a row: adaptive execution would leave them in one task
    state = settle(state.repartition(2 * state.sparkSession.sparkContext.defaultParallelism))
    tree, _ = search(state, names)
    return tree, branch_rows(tree, state, names)
