"""Tree text, distance, rerooting, clustering, alignment, quartets."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeloom.functions import likelihood, msa, quartets, trees
from cladeloom.functions.trees import Node


def random_tree(names, rng):
    nodes = [Node(n, rng.random()) for n in names]
    while len(nodes) > 1:
        a, b = nodes.pop(rng.randrange(len(nodes))), nodes.pop(rng.randrange(len(nodes)))
        nodes.append(Node(children=[a, b], length=rng.random()))
    return nodes[0]


def path_lengths(tree, names):
    up = {id(c): n for n in tree.walk() for c in n.children}
    chain = {}
    for n in tree.walk():
        if not n.children:
            steps, at, total = {}, n, 0.0
            while at is not None:
                steps[id(at)] = total
                total += at.length or 0
                at = up.get(id(at))
            chain[n.name] = steps
    out = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i != j:
                out[i, j] = min(chain[a][k] + chain[b][k] for k in chain[a] if k in chain[b])
    return out


@given(st.integers(0, 10_000), st.integers(4, 14))
@settings(max_examples=40, deadline=None)
def test_newick_round_trip_and_distance_properties(seed, n):
    rng = random.Random(seed)
    names = [f"t-{k}.x_{k}" for k in range(n)]
    a, b = random_tree(names, rng), random_tree(names, rng)
    again = trees.parse(trees.text_of(a))
    assert trees.splits(again) == trees.splits(a) and again.tips() == a.tips()
    assert trees.robinson_foulds(a, again) == 0
    assert trees.robinson_foulds(a, b) == trees.robinson_foulds(b, a)
    out = rng.choice([x for x in a.walk() if x is not a])
    turned = trees.reroot(a, out)
    assert trees.splits(turned) == trees.splits(a) and sorted(turned.tips()) == sorted(names) and len(turned.children) == 2
    assert np.allclose(path_lengths(turned, names), path_lengths(a, names))


@given(st.integers(0, 10_000), st.integers(4, 12))
@settings(max_examples=25, deadline=None)
def test_neighbour_joining_recovers_additive_trees(seed, n):
    rng = random.Random(seed)
    names = [f"t{k}" for k in range(n)]
    tree = random_tree(names, rng)
    for x in tree.walk():
        x.length = 0.1 + (x.length or 0)
    d = path_lengths(tree, names)
    found = trees.neighbour_joining(names, d)
    assert trees.splits(found) == trees.splits(tree)
    assert np.allclose(path_lengths(found, names), d)


def test_newick_forms():
    t = trees.parse("((a:1,'b c':2e-1)0.9:1,(c:1,d)[note]x:2,e);")
    assert t.tips() == ["a", "b c", "c", "d", "e"] and t.children[0].support == 0.9 and t.children[1].name == "x"
    assert trees.parse("(a,b,(c,d));").tips() == ["a", "b", "c", "d"] and trees.parse("a;").tips() == ["a"]
    for bad in ("((a,b);", "a,b;", "(a,b));", "('a,b);"):
        with pytest.raises(ValueError):
            trees.parse(bad)


def test_reroot_by_reference():
    ref = trees.parse("((a,b),((c,d),e));")
    assert trees.outgroup_tips(ref) == {"a", "b"}
    tree = trees.parse("(((a,b),c),d,e);")
    assert set(trees.best_outgroup(tree, ref).tips()) == {"a", "b"}
    turned = trees.reroot(tree, trees.best_outgroup(tree, ref))
    assert {frozenset(c.tips()) for c in turned.children} == {frozenset("ab"), frozenset("cde")}
    with pytest.raises(ValueError):
        trees.outgroup_tips(trees.parse("(a,b,c);"))


def test_neighbours_are_one_interchange_away():
    t = trees.parse("((a,b),((c,d),(e,f)),g);")
    own = trees.splits(t)
    found = [trees.splits(x) for x in trees.neighbours(t)]
    assert len(found) >= 2 * len(own) and all(len(own - s) <= 1 for s in found)


def test_progressive_alignment():
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    seqs = {"a": base, "b": base[:40] + base[44:], "c": base[:80] + "GG" + base[80:], "d": base.replace("AC", "AG", 2)}
    rows = msa.progressive(list(seqs), list(seqs.values()))
    assert len({len(r) for r in rows.values()}) == 1 and all(rows[k].replace("-", "") == s for k, s in seqs.items())
    assert len(rows["a"]) <= 124
    assert msa.progressive(["x", "y"], ["AC", "ac"]) == {"x": "AC", "y": "ac"}


def test_distances_and_local_alignment():
    d = msa.distances(["ACGTACGT", "ACGTACGA", "ACGTACG-"])
    assert d[0, 1] == d[1, 0] > 0 and d[0, 2] == 0
    score, at, a, b = msa.local_align("GGACGTTT", "CCCCACGTTTCC")
    assert (score, at, a, b) == (12.0, 4, "ACGTTT", "ACGTTT")
    assert msa.local_align("", "A")[0] == 0
    assert msa.local_align("ACGT", "ACGT", msa.HOXD55, 120.0)[0] == 382


def test_exhaustive_search_finds_the_tree():
    rng = random.Random(6)
    for n in (4, 5, 7):
        names = [f"s{k}" for k in range(n)]
        truth = random_tree(names, rng)
        weight = {}
        for t in quartets.topologies(trees.tip_steps(truth, names)):
            weight.setdefault(t[:4], np.zeros(3))[t[4]] += 5
        assert trees.splits(quartets.exhaustive(names, weight)) == trees.splits(truth)


def brute_counts(gene, own, species_of):
    """Quartets of species by listing every one, and every choice of copies."""
    tips = gene.tips()
    steps = trees.tip_steps(gene, tips)
    copies = {}
    for k, t in enumerate(tips):
        copies.setdefault(species_of(t), []).append(k)
    out, every = np.zeros((3, len(own))), np.zeros(len(own))
    for b, branch in enumerate(own):
        for four in itertools.product(*(sorted(s & set(copies)) for s in branch.sides)):
            every[b] += 1
            n = np.prod([len(copies[x]) for x in four])
            for p, q, r, s in itertools.product(*(copies[x] for x in four)):
                sums = [steps[p, q] + steps[r, s], steps[p, r] + steps[q, s], steps[p, s] + steps[q, r]]
                low = sorted(sums)
                if low[0] < low[1]:
                    out[sums.index(low[0]), b] += 1 / n
    return out, every


def test_branch_counts_match_all_quartets():
    rng = random.Random(9)
    names = [f"s{k}" for k in range(9)]
    at = {n: k for k, n in enumerate(names)}
    for trial in range(6):
        own = quartets.branches(random_tree(names, rng))
        assert len(own) == len(names) - 3 and all(frozenset().union(*b.sides) == frozenset(names) and sum(map(len, b.sides)) == len(names) for b in own)
        colours = np.zeros((4, len(own), len(names)))
        for b, branch in enumerate(own):
            for side in range(4):
                colours[side, b, [at[n] for n in branch.sides[side]]] = 1
        tips = [f"{n}_{c}" for n in rng.sample(names, 8) for c in range(rng.choice([1, 1, 2]))]
        gene = random_tree(tips, rng)
        if trial % 2:  # a polytomy
            inner = [n for n in gene.walk() if n.children and n is not gene]
            gone = rng.choice(inner)
            up = next(n for n in gene.walk() if any(c is gone for c in n.children))
            up.children = [c for c in up.children if c is not gone] + gone.children
        species_of = lambda t: t.rsplit("_", 1)[0]
        got, want = quartets.branch_counts(gene, species_of, at, colours), brute_counts(gene, own, species_of)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_interchanges_find_the_tree_and_each_gain_is_exact():
    rng = random.Random(3)
    names = [f"s{k:02}" for k in range(12)]
    at = {n: k for k, n in enumerate(names)}
    truth = random_tree(names, rng)
    genes = [truth] * 3

    def counts_of(own):
        colours = np.zeros((4, len(own), len(names)))
        for b, branch in enumerate(own):
            for side in range(4):
                colours[side, b, [at[n] for n in branch.sides[side]]] = 1
        return sum(quartets.branch_counts(g, lambda t: t, at, colours)[0] for g in genes).T

    weight = {}
    for g in genes:
        for t in quartets.topologies(trees.tip_steps(g, names)):
            weight.setdefault(t[:4], np.zeros(3))[t[4]] += 1
    for _ in range(3):
        start = random_tree(names, rng)
        own = quartets.branches(start)
        counts = counts_of(own)
        k = int((counts[:, 1:].max(axis=1) - counts[:, 0]).argmax())
        before = quartets.tree_score(start, names, weight)
        pairing = 1 + int(counts[k, 1:].argmax())
        quartets.interchange(own[k], pairing)
        assert quartets.tree_score(start, names, weight) - before == pytest.approx(counts[k, pairing] - counts[k, 0])
        near = trees.parse(trees.text_of(truth, lengths=False))
        for b in rng.sample(quartets.branches(near), 1):
            quartets.interchange(b, 1)
        assert trees.splits(near) != trees.splits(truth)
        assert trees.splits(quartets.improve(near, counts_of)) == trees.splits(truth)


def test_local_posterior():
    assert quartets.local_posterior((0, 0, 0)) == pytest.approx(1 / 3)
    a = [quartets.local_posterior(p) for p in ((10, 5, 3), (5, 10, 3), (3, 10, 5))]
    assert sum(a) == pytest.approx(1, abs=0.02) and a[0] > a[1] > a[2]


def test_multi_copy_steps():
    t = trees.parse("((a_0,a_1),(b_0,(c_0,d_0)));")
    steps = quartets.species_steps(t, lambda x: x.rsplit("_", 1)[0], list("abcde"))
    assert np.isnan(steps[0, 4]) and quartets.topologies(steps) == [(0, 1, 2, 3, 0)]


def simulate(tree, length, rng):
    """Sequences along a tree by the Jukes-Cantor model, from the lengths of its branches."""
    out = {}

    def walk(node, seq):
        for c in node.children:
            p = 0.75 * (1 - np.exp(-4 * c.length / 3))
            walk(c, [rng.choice([x for x in "ACGT" if x != b]) if rng.random() < p else b for b in seq])
        if not node.children:
            out[node.name] = "".join(seq)

    walk(tree, [rng.choice("ACGT") for _ in range(length)])
    return out


def test_likelihood_fits_branch_lengths():
    rng = random.Random(2)
    # two sequences: the distance is known in closed form
    two = simulate(trees.parse("(a:0.2,b:0.1);"), 3000, rng)
    t = trees.parse("(a,b);")
    tips, weight = likelihood.patterns(two)
    score = likelihood.fit(t, tips, weight, 8)
    p = np.mean([x != y for x, y in zip(two["a"], two["b"])])
    assert sum(c.length for c in t.children) == pytest.approx(-0.75 * np.log(1 - 4 * p / 3), rel=0.02)
    assert score == pytest.approx(3000 * (np.log(1 / 4) + (1 - p) * np.log(1 - p) + p * np.log(p / 3)), rel=1e-4)
    # lengths of a five-taxon tree come back, and no small change of one is better
    truth = trees.parse("((a:0.3,b:0.05):0.1,(c:0.2,d:0.02):0.15,e:0.4);")
    rows = simulate(truth, 4000, rng)
    tips, weight = likelihood.patterns(rows)
    t = trees.parse("((a,b),(c,d),e);")
    best = likelihood.fit(t, tips, weight, 12)
    for x, y in zip(list(t.walk())[1:], list(truth.walk())[1:]):
        assert abs(x.length - y.length) < 0.04
        was = x.length
        for f in (0.9, 1.1):
            x.length = was * f
            assert likelihood.fit(t, tips, weight, 0) <= best + 0.05
        x.length = was
    assert likelihood.fit(trees.parse("((a,c),(b,d),e);"), tips, weight, 12) < best - 20


def test_long_branches_do_not_attract_each_other():
    """Two long branches on either side: fitted lengths tell the tree, one length for all would not."""
    rng = random.Random(5)
    truth = trees.parse("((a:0.6,b:0.05):0.06,(c:0.6,d:0.05):0.06);")
    rows = simulate(truth, 4000, rng)
    tips, weight = likelihood.patterns(rows)
    scores = {text: likelihood.fit(trees.parse(text), tips, weight, 10) for text in ("((a,b),c,d);", "((a,c),b,d);", "((a,d),b,c);")}
    assert max(scores, key=scores.get) == "((a,b),c,d);"
