"""Species trees from gene trees by quartets, and branch support.

A species tree scores the quartets of the gene trees that it agrees with.  An interchange across a
branch with A, B on one side and C, D on the other changes only quartets with one species from each,
so its gain is the number of those that pair as in the new tree less those that pair as in the old.
These numbers come from one walk over each gene tree, by counting the species of A, B, C and D in the
parts around every node: species times branches of work a tree, and no quartet is listed.  Up to
``EXHAUSTIVE`` species every tree is tried instead.  An approximation of quartet summary programs, not
an equal of any.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from . import trees
from .trees import Node

# The three topologies of a quartet (a, b, c, d), a < b < c < d: which tip pairs with a.
PAIRINGS = ((0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2))
EXHAUSTIVE = 7


def species_steps(tree: Node, species_of, names: list[str]) -> np.ndarray:
    """Mean branches between the copies of two species; NaN where one is absent."""
    tips = tree.tips()
    own = [f"{k}" for k in range(len(tips))]
    for k, node in enumerate(n for n in tree.walk() if not n.children):
        node.name = own[k]
    steps = trees.tip_steps(tree, own)
    at = {n: k for k, n in enumerate(names)}
    who = np.array([at[species_of(t)] for t in tips])
    member = np.zeros((len(names), len(tips)))
    member[who, np.arange(len(tips))] = 1
    n = member.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return member @ steps @ member.T / np.outer(n, n)


def topologies(steps: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """``(a, b, c, d, pairing)`` of the quartets that a tree resolves, by the four-point condition."""
    have = np.flatnonzero(~np.isnan(np.diag(steps)))
    if len(have) < 4:
        return []
    q = np.array(list(combinations(have.tolist(), 4)))
    sums = np.stack([steps[q[:, p[0]], q[:, p[1]]] + steps[q[:, p[2]], q[:, p[3]]] for p in PAIRINGS], axis=1)
    low = np.sort(sums, axis=1)
    clear = low[:, 0] < low[:, 1] - 1e-9
    best = sums.argmin(axis=1)
    return [(*map(int, row), int(k)) for row, k, ok in zip(q, best, clear) if ok]


def tree_score(tree: Node, names: list[str], weight: dict[tuple, np.ndarray]) -> float:
    steps = trees.tip_steps(tree, names)
    return sum(float(weight[t[:4]][t[4]]) for t in topologies(steps) if t[:4] in weight)


def all_unrooted(names: list[str]) -> list[Node]:
    """Every unrooted binary tree, by adding tips to branches."""
    out = [f"({names[0]},{names[1]},{names[2]});"] if len(names) > 2 else ["(" + ",".join(names) + ");"]
    for tip in names[3:]:
        grown = []
        for text in out:
            size = sum(1 for _ in trees.parse(text).walk())
            for k in range(1, size):
                t = trees.parse(text)
                nodes = list(t.walk())
                up = next(p for p in nodes if any(c is nodes[k] for c in p.children))
                up.children[next(i for i, c in enumerate(up.children) if c is nodes[k])] = Node(children=[nodes[k], Node(tip)])
                grown.append(trees.text_of(t, lengths=False))
        out = grown
    return [trees.parse(t) for t in out]


def exhaustive(names: list[str], weight: dict[tuple, np.ndarray]) -> Node:
    """The best of all trees of up to ``EXHAUSTIVE`` species."""
    if len(names) < 4:
        return Node(children=[Node(n) for n in names])
    return max(all_unrooted(names), key=lambda t: tree_score(t, names, weight))


@dataclass
class Branch:
    """An inner branch: the nodes whose subtrees are A, B, C, D; A and B lie below it."""

    node: Node
    up: Node
    below: list[Node]
    beside: list[Node]
    sides: tuple[frozenset[str], frozenset[str], frozenset[str], frozenset[str]]


def branches(tree: Node) -> list[Branch]:
    """The inner branches of the unrooted binary tree, each once, in pre-order.

    Of a node with more than two children below, or beside it, the first two groups count.
    """
    rows = list(tree.walk())
    parent = {id(c): n for n in rows for c in n.children}
    tips = {}
    for n in reversed(rows):
        tips[id(n)] = frozenset().union(*(tips[id(c)] for c in n.children)) if n.children else frozenset([n.name])
    every, out, seen = tips[id(tree)], [], set()
    for node in rows:
        if node is tree or len(node.children) < 2:
            continue
        side = tips[id(node)]
        key = min(side, every - side, key=lambda s: (len(s), sorted(s)))
        if key in seen or not 2 <= len(side) <= len(every) - 2:
            continue
        seen.add(key)
        up = parent[id(node)]
        others = [c for c in up.children if c is not node]
        if up is tree and len(others) == 1:  # a root with two children is no node: beside are the other's children
            beside = others[0].children
            fourth = every - side - tips[id(beside[0])]
        else:
            beside = others
            fourth = every - side - tips[id(beside[0])]
        if len(beside) < 1 or not fourth:
            continue
        out.append(Branch(node, up, node.children[:2], list(beside), (tips[id(node.children[0])], frozenset().union(*(tips[id(c)] for c in node.children[1:])), tips[id(beside[0])], fourth)))
    return out


def branch_counts(gene_tree: Node, species_of, at: dict[str, int], colours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one gene tree, per branch: quartets with a species from each side that pair as AB|CD, AC|BD
    and AD|BC, and all such quartets.

    ``colours`` is (4, branches, species): which species each side has.  A copy counts as its share of
    its species' copies, so every quartet of species has one vote.
    """
    rows = list(gene_tree.walk())
    tips = [n for n in rows if not n.children]
    who = np.array([at[species_of(n.name)] for n in tips])
    share = 1.0 / np.bincount(who, minlength=len(at))[who]
    shape = colours.shape[:2]
    below = {id(n): colours[:, :, w] * s for n, w, s in zip(tips, who, share)}
    for n in reversed(rows):
        if n.children:
            below[id(n)] = sum(below[id(c)] for c in n.children)
    total = below[id(gene_tree)]
    out = np.zeros((3, shape[1]))
    for n in rows:
        if not n.children:
            continue
        parts = [below[id(c)] for c in n.children]
        if n is not gene_tree:
            parts.append(total - below[id(n)])
        if len(parts) < 3:
            continue
        part = np.stack(parts)  # parts, sides, branches
        for k, (p, q, r, s) in enumerate(PAIRINGS):
            # p and q meet here, in two parts, while r and s are in a third
            p_else, q_else = total[p] - part[:, p], total[q] - part[:, q]
            apart = p_else * q_else - ((part[:, p] * part[:, q]).sum(axis=0) - part[:, p] * part[:, q])
            out[k] += (part[:, r] * part[:, s] * apart).sum(axis=0)
    have = np.bincount(who, minlength=len(at)) > 0
    return out, np.prod((colours * have).sum(axis=2), axis=0)


def interchange(branch: Branch, pairing: int) -> None:
    """Swap in place so that A pairs with C (1) or with D (2)."""
    moved, swapped = branch.below[1], branch.beside[0]
    if pairing == 2:
        moved = branch.below[0]
    home = branch.up if any(c is swapped for c in branch.up.children) else next(c for c in branch.up.children if c is not branch.node)
    branch.node.children[next(i for i, c in enumerate(branch.node.children) if c is moved)] = swapped
    home.children[next(i for i, c in enumerate(home.children) if c is swapped)] = moved


def improve(tree: Node, counts_of, most: int = 100) -> Node:
    """Interchanges until none gains.  ``counts_of(branches)`` gives their quartet numbers (branches, 3),
    one pass over the gene trees a round; in a round the best gains that touch no common node are made."""
    tree = trees.parse(trees.text_of(tree, lengths=False))
    for _ in range(most):
        own = branches(tree)
        if not own:
            return tree
        counts = counts_of(own)
        gain = counts[:, 1:].max(axis=1) - counts[:, 0]
        touched: set[int] = set()
        for k in np.argsort(-gain, kind="stable").tolist():
            if gain[k] <= 1e-9:
                break
            b = own[k]
            near = {id(x) for x in (b.node, b.up, *b.below, *b.beside)}
            if near & touched:
                continue
            touched |= near
            interchange(b, 1 + int(counts[k, 1:].argmax()))
        if not touched:
            return tree
    return tree


def _log_half(x: float, n: float, lam: float) -> float:
    """Log of the Beta(x + 1, n - x + 2 lam) mass above one third, unnormalised."""
    a, b = x + 1, n - x + 2 * lam
    t = np.linspace(1 / 3, 1, 4001)[1:-1]
    y = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t)
    top = y.max()
    return float(top + math.log(np.exp(y - top).sum() * (t[1] - t[0])))


def local_posterior(z: tuple[float, float, float], lam: float = 0.5) -> float:
    """Posterior of the first topology given effective quartet counts, as published."""
    n = sum(z)
    if n <= 0:
        return 1 / 3
    # the two other topologies share what is left equally, hence a factor of two per own quartet
    logs = [_log_half(x, n, lam) + x * math.log(2) for x in z]
    top = max(logs)
    w = [math.exp(v - top) for v in logs]
    return w[0] / sum(w)


def supports(z: np.ndarray) -> list[float]:
    """Posteriors of a branch's three pairings given effective quartet counts."""
    return [local_posterior(tuple(p)) for p in ((z[0], z[1], z[2]), (z[1], z[0], z[2]), (z[2], z[0], z[1]))]
