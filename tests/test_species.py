"""Speciations of multi-copy trees, the constrained search and branch statistics against direct counting."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from cladeloom.functions import quartets, trees
from cladeloom.operators import tripartitions
from cladeloom.operators.trees import nodes
from cladeloom.plans import converge, species


def _random_tree(tips: list[str], rng: random.Random) -> trees.Node:
    own = [trees.Node(t) for t in tips]
    while len(own) > 3:
        a = own.pop(rng.randrange(len(own)))
        b = own.pop(rng.randrange(len(own)))
        own.append(trees.Node(children=[a, b]))
    return trees.Node(children=own)


def _kind(tip: str) -> str:
    return tip.rsplit("_", 1)[0]


def _edges(tree: trees.Node) -> list[frozenset]:
    return [frozenset(n.tips()) for n in tree.walk() if n is not tree]


def _rootings(tree: trees.Node) -> dict[frozenset, trees.Node]:
    out = {}
    for k, _ in enumerate(tree.walk()):
        if k:
            copy = trees.parse(trees.text_of(tree))
            node = list(copy.walk())[k]
            side = frozenset(node.tips())
            out[side] = trees.reroot(copy, node)
    return out


def _duplications(tree: trees.Node) -> int:
    return sum(_clashes(n) for n in tree.walk() if n.children)


def _clashes(node: trees.Node) -> bool:
    sets = [{_kind(t) for t in c.tips()} for c in node.children]
    return sum(map(len, sets)) > len(set().union(*sets))


def _parts_of(rooted: trees.Node) -> list[set[str]]:
    """Tips of the parts that duplications cut a rooted tree into."""
    out, todo = [], [rooted]
    while todo:
        top = todo.pop()
        own = set(top.tips())
        walk = [top]
        while walk:
            node = walk.pop()
            if not node.children:
                continue
            keep = node.children
            if _clashes(node):
                best = max(range(len(keep)), key=lambda k: (len(keep[k].tips()), -k))
                for k, c in enumerate(keep):
                    if k != best:
                        todo.append(c)
                        own -= set(c.tips())
                keep = [keep[best]]
            walk += keep
        out.append(own)
    return out


def _quartets(tree: trees.Node, keep: set[str]) -> dict[tuple, int]:
    """The pairing of every four of ``keep`` that the tree resolves."""
    names = sorted(tree.tips())
    steps = trees.tip_steps(tree, names)
    out = {}
    for t in quartets.topologies(steps):
        four = [names[k] for k in t[:4]]
        if set(four) <= keep:
            kinds = [_kind(x) for x in four]
            order = sorted(range(4), key=lambda k: kinds[k])
            mates = [quartets.PAIRINGS[t[4]][:2], quartets.PAIRINGS[t[4]][2:]]
            pair = next(m for m in mates if order[0] in m)
            mate = next(k for k in pair if k != order[0])
            out[tuple(sorted(kinds))] = order.index(mate) - 1
    return out


def _told(rows: list) -> dict[tuple, dict[int, float]]:
    """Votes for pairings of four species from a table of speciations; each quartet is met at two nodes."""
    out: dict = {}
    for parts, n in rows:
        for i in range(len(parts)):
            for r, s in itertools.combinations(parts[i], 2):
                for j, k in itertools.combinations([x for x in range(len(parts)) if x != i], 2):
                    for p, q in itertools.product(parts[j], parts[k]):
                        four = tuple(sorted((p, q, r, s)))
                        first = four[0]
                        mate = next(y for x, y in ((r, s), (s, r), (p, q), (q, p)) if x == first)
                        own = out.setdefault(four, {})
                        own[four.index(mate) - 1] = own.get(four.index(mate) - 1, 0) + n / 2
    return out


def _multi(rng: random.Random, kinds: str, copies: int) -> trees.Node:
    return _random_tree([f"{k}_{c}" for k in kinds for c in range(rng.randrange(1, copies + 1)) if rng.random() < 0.9], rng)


def _state(spark, texts: list[str]):
    return species.speciations(spark.createDataFrame(list(enumerate(texts)), "gene_id int, newick string"))


def test_duplications_roots_and_votes(spark):
    rng = random.Random(6)
    own = [_multi(rng, "abcdef", 3) for _ in range(25)]
    own = [t for t in own if len(t.tips()) >= 4]
    texts = [trees.text_of(t) for t in own]
    df = spark.createDataFrame(list(enumerate(texts)), "tree_id int, newick string")
    table, roots = tripartitions.rooted(nodes(df))
    found = {r["tree"]: r for r in roots.collect()}
    tags = {}
    for r in tripartitions.tagged(nodes(df)).collect():
        tags.setdefault(r["tree"], []).append(r["duplication"])
    votes: dict = {}
    for k, tree in enumerate(own):
        options = _rootings(tree)
        fewest = min(map(_duplications, options.values()))
        at = list(tree.walk())[found[k]["root"]]
        best = options[frozenset(at.tips())]
        assert found[k]["duplications"] == fewest == _duplications(best)
        assert sum(tags[k]) + _clashes(best) == fewest
        for part in _parts_of(best):
            assert len({_kind(t) for t in part}) == len(part)
            for four, pairing in _quartets(tree, part).items():
                votes.setdefault(four, {})[pairing] = votes.get(four, {}).get(pairing, 0) + 1
    got = _told([(r["parts"], r["n"]) for r in _state(spark, texts).collect()])
    assert got == votes and len(votes) > 10


def _simulate(rng: random.Random, truth: trees.Node, swaps: int) -> trees.Node:
    tree = trees.parse(trees.text_of(truth, lengths=False))
    for _ in range(swaps):
        quartets.interchange(rng.choice(quartets.branches(tree)), rng.choice([1, 2]))
    return tree


def test_paralogues_mislead_means_but_not_speciations(spark):
    """Two ancient copies, one of which each species has lost at random: the tree across copies is wrong,
    the speciations within a copy are right."""
    rng = random.Random(3)
    truth = trees.parse("((((a,b),c),d),(e,(f,(g,h))));")
    texts = []
    for _ in range(60):
        two = []
        for copy in (0, 1):
            t = trees.parse(trees.text_of(truth, lengths=False))
            lost = {"a", "c", "e", "g"} if copy else {"b", "h"}
            keep = {x for x in "abcdefgh" if x not in lost or rng.random() < 0.1}
            two.append(_prune(t, keep, copy))
        texts.append(f"({two[0]},{two[1]});")
    tree, _ = species.tree_and_stats(_state(spark, texts), list("abcdefgh"))
    assert trees.robinson_foulds(tree, truth) == 0


def _prune(tree: trees.Node, keep: set[str], copy: int) -> str:
    def walk(n: trees.Node) -> str:
        if not n.children:
            return f"{n.name}_{copy}" if n.name in keep else ""
        own = [x for x in map(walk, n.children) if x]
        return "(" + ",".join(own) + ")" if len(own) > 1 else "".join(own)

    return walk(tree)


@pytest.mark.parametrize("n", [4, 5, 6])
def test_equal_to_the_best_of_all_trees(spark, n):
    rng = random.Random(n)
    names = list("abcdef")[:n]
    texts = [trees.text_of(_random_tree([f"{x}_0" for x in (names if rng.random() < 0.6 else rng.sample(names, max(4, n - 1)))], rng)) for _ in range(30)]
    state = _state(spark, texts)
    tree, score = species.search(state, names)
    told = _told([(r["parts"], r["n"]) for r in state.collect()])

    def of(t: trees.Node) -> float:
        own = _quartets(trees.parse(trees.text_of(t).replace(",", "_0,").replace(")", "_0)").replace(")_0", ")")), {f"{x}_0" for x in names})
        return sum(told.get(four, {}).get(p, 0) for four, p in own.items())

    best = max(map(of, quartets.all_unrooted(names)))
    assert score == pytest.approx(best) == of(tree)


def test_never_below_interchanges_and_many_species(spark):
    rng = random.Random(1)
    names = [f"s{k:03}" for k in range(240)]
    truth = _random_tree(names, rng)
    texts = [trees.text_of(_simulate(rng, truth, 60), lengths=False) for _ in range(25)]
    texts = [t.replace(",", "_0,").replace(")", "_0)").replace(")_0", ")") for t in texts]
    state = _state(spark, texts).persist()
    tree, score = species.search(state, names, 2000)
    near = quartets.improve(species.start_tree(state, names), lambda own: species.branch_counts(state, names, own)[0])

    def of(t: trees.Node) -> float:
        own = sorted(species._clusters_of(t, {x: k for k, x in enumerate(names)}), key=lambda c: (c.bit_count(), c))
        which = species.triples(spark, own, len(names))
        return species.best_tree(names, own, which, species.weights(state, names, own, which))[1]

    assert of(tree) == pytest.approx(score) and score >= of(near) - 1e-6
    assert sorted(tree.tips()) == names and trees.robinson_foulds(tree, truth) < 0.05


def test_branch_statistics(spark):
    """Frequencies of a branch met 6, 3 and 1 times, and the published closed forms."""
    texts = ["((a_0,b_0),c_0,d_0);"] * 6 + ["((a_0,c_0),b_0,d_0);"] * 3 + ["((a_0,d_0),b_0,c_0);"]
    tree, rows = species.tree_and_stats(_state(spark, texts), list("abcd"))
    assert [r[4] for r in rows] == [6, 3, 1] and [r[5] for r in rows] == pytest.approx([0.6, 0.3, 0.1]) and {r[6] for r in rows} == {10}
    assert rows[0][7] == pytest.approx(-math.log(1.5 * (1 - 6 / 11))) and rows[1][7] == rows[2][7] == 0
    assert sum(r[3] for r in rows) == pytest.approx(1) and rows[0][3] == pytest.approx(quartets.local_posterior((6, 3, 1)))
    assert species.branch_length(0, 0) == 0 and species.branch_length(1e9, 1e9) > 15
    # a quarter of a tree's quartets around a branch has a quarter of a vote
    some = _state(spark, ["(((a_0,e_0),b_0),c_0,d_0);", "((a_0,b_0),c_0,d_0);", "((a_0,c_0),(b_0,e_0),d_0);"])
    own = quartets.branches(trees.parse("(((a,e),b),c,d);"))
    counts, z = species.branch_counts(some, list("abcde"), own)
    for b, branch in enumerate(own):
        told = [0.0] * 3
        for text in ("(((a_0,e_0),b_0),c_0,d_0);", "((a_0,b_0),c_0,d_0);", "((a_0,c_0),(b_0,e_0),d_0);"):
            t = trees.parse(text)
            pairings = _quartets(t, set(t.tips()))
            here = {_kind(x) for x in t.tips()}
            fours = [f for f in itertools.product(*(sorted(s & here) for s in branch.sides))]
            for f in fours:
                mate = sorted(f)[pairings[tuple(sorted(f))] + 1] if tuple(sorted(f)) in pairings else None
                if mate:
                    pair = {sorted(f)[0], mate}
                    k = next(i for i, (p, q, r, s) in enumerate(quartets.PAIRINGS) if pair in ({f[p], f[q]}, {f[r], f[s]}))
                    told[k] += 1 / len(fours)
        assert z[b] == pytest.approx(told)


def test_a_round_reads_its_own_trees_only(spark, tmp_path):
    """The merged state gives the same speciations as all rounds read again, also when the older trees are gone."""
    rng = random.Random(4)
    texts = [trees.text_of(_multi(rng, "abcdef", 2)) for _ in range(24)]
    for k in (1, 2, 3):
        rows = [(100 * k + j, t) for j, t in enumerate(texts[8 * (k - 1) : 8 * k])]
        spark.createDataFrame(rows, "gene_id int, newick string").coalesce(1).write.parquet(f"{tmp_path}/gene_trees/iteration={k}")
        state, names = converge.state_of(spark, str(tmp_path), k)
        got = {(str(r["parts"]), r["n"]) for r in state.collect()}
        (tmp_path / "gene_trees" / f"iteration={k}").rename(tmp_path / f"gone{k}")
    assert got == {(str(r["parts"]), r["n"]) for r in _state(spark, texts).collect()} and names == list("abcdef")


def test_few_or_no_species(spark):
    none = spark.createDataFrame([], "gene_id int, newick string")
    assert species.species_names(none) == [] and species.tree_and_stats(species.speciations(none), []) == (None, [])
    two = _state(spark, ["(a_0,b_0);", None])
    assert sorted(species.tree_and_stats(two, ["a", "b"])[0].tips()) == ["a", "b"]
    four = spark.createDataFrame([], tripartitions.STATE)
    tree, rows = species.tree_and_stats(four, list("abcde"))
    assert sorted(tree.tips()) == list("abcde") and all(r[4] == 0 for r in rows)
