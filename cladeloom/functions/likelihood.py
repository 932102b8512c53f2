"""Jukes-Cantor likelihood of a tree with fitted branch lengths.

Along a branch with ``e = exp(-4 t / 3)`` a site's likelihood is ``e a + (1 - e) b``: a is what both
sides of the branch give for equal bases, b for independent ones.  Its logarithm, summed over sites, is
concave in e, so each branch has one best length given the others; rounds over all branches fit a tree.
"""

from __future__ import annotations

import numpy as np

from . import msa
from .trees import Node

SHORTEST, LONGEST, START = 1e-6, 5.0, 0.1


def patterns(rows: dict[str, str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Per tip the site patterns as (patterns, 4) of zeros and ones, gaps all ones; and their counts."""
    names = sorted(rows)
    codes = np.stack([msa.codes(rows[n]) for n in names])
    columns, weight = np.unique(codes, axis=1, return_counts=True)
    table = np.concatenate([np.eye(4), np.ones((2, 4))])
    return {n: table[np.minimum(c, 4)] for n, c in zip(names, columns)}, weight.astype(float)


def _along(part: np.ndarray, length: float) -> np.ndarray:
    e = np.exp(-4 * length / 3)
    return e * part + (1 - e) * part.mean(axis=1, keepdims=True)


def _scaled(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out = np.prod(parts, axis=0)
    top = out.max(axis=1, keepdims=True)
    return out / top, np.log(top[:, 0])


def _best_length(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Where the sum of w log(e a + (1 - e) b) is greatest: Newton's steps, kept inside a bracket."""
    lo, hi = np.exp(-4 * LONGEST / 3), np.exp(-4 * SHORTEST / 3)
    turn = a - b

    def slope(e: float) -> tuple[float, float]:
        share = turn / (b + e * turn)
        return float(weight @ share), float(weight @ (share * share))

    if slope(hi)[0] >= 0:
        return SHORTEST
    if slope(lo)[0] <= 0:
        return LONGEST
    e = (lo + hi) / 2
    for _ in range(30):
        g, h = slope(e)
        lo, hi = (e, hi) if g > 0 else (lo, e)
        step = e + g / h if h > 0 else (lo + hi) / 2
        step = step if lo < step < hi else (lo + hi) / 2
        if abs(step - e) < 1e-7:
            break
        e = step
    return float(-0.75 * np.log(e))


def fit(tree: Node, tips: dict[str, np.ndarray], weight: np.ndarray, rounds: int = 3) -> float:
    """Sets the lengths of all branches, and returns the log likelihood.

    A round takes the branches from the root down; what lies above a branch is up to date, what lies
    below it is of the round before.
    """
    order = list(tree.walk())
    for n in order[1:]:
        n.length = START if n.length is None else min(max(n.length, SHORTEST), LONGEST)
    for k in range(rounds + 1):
        below, scale = {}, np.zeros(len(weight))
        for n in reversed(order):
            if not n.children:
                below[id(n)] = tips[n.name]
                continue
            below[id(n)], log = _scaled([_along(below[id(c)], c.length) for c in n.children])
            scale += log
        score = float(weight @ (np.log(below[id(tree)].mean(axis=1)) + scale))
        if k == rounds:
            return score
        above = {id(tree): np.ones_like(below[id(tree)])}
        for n in order:
            for c in n.children:
                others = [_along(below[id(x)], x.length) for x in n.children if x is not c]
                up, _ = _scaled([above[id(n)], *others])
                down = below[id(c)]
                c.length = _best_length((up * down).mean(axis=1), up.mean(axis=1) * down.mean(axis=1), weight)
                above[id(c)] = _along(up, c.length)
    return score
