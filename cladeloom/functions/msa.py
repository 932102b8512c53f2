"""Alignment of a gene's sequences, and distances between aligned rows.

These are small published schemes (progressive profile alignment with a linear gap cost, local
alignment, Jukes-Cantor and Kimura distances).  They approximate dedicated aligners and
maximum-likelihood programs and do not claim to equal any.
"""

from __future__ import annotations

import math

import numpy as np

from .trees import Node, average_linkage

BASES = "ACGT-"
MATCH, MISMATCH, GAP = 2.0, -2.0, 3.0

# The published HOXD55 substitution scores, in the order A C G T.
HOXD55 = [
    [91, -90, -25, -100],
    [-90, 100, -100, -25],
    [-25, -100, 100, -90],
    [-100, -25, -90, 91],
]

_CODE = np.full(256, 4, np.int64)
for _k, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _k


def codes(seq: str) -> np.ndarray:
    """0..3 for bases of either case, 4 for anything else."""
    return _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def kmer_distance(a: str, b: str, k: int = 6) -> float:
    x, y = ({s[i : i + k] for i in range(len(s) - k + 1)} for s in (a.upper(), b.upper()))
    return 1 - len(x & y) / max(1, min(len(x), len(y)))


def _profile(rows: list[str]) -> np.ndarray:
    """Share of A, C, G, T and gap per column."""
    out = np.zeros((len(rows[0]), 5))
    for r in rows:
        out[np.arange(len(r)), codes(r)] += 1
    return out / len(rows)


_SCORE = np.full((5, 5), MISMATCH)
np.fill_diagonal(_SCORE, MATCH)
_SCORE[4, :], _SCORE[:, 4], _SCORE[4, 4] = -GAP / 2, -GAP / 2, 0.0


def _trace(p: np.ndarray, q: np.ndarray) -> tuple[list[int], list[int]]:
    """Columns of either profile per column of their global alignment; -1 is a gap."""
    s = p @ _SCORE @ q.T
    n, m = s.shape
    step = np.zeros((n + 1, m + 1), np.int8)  # 0 both, 1 from p, 2 from q
    step[0, 1:], step[1:, 0] = 2, 1
    gap = GAP * np.arange(m + 1)
    row = -gap
    for i in range(n):
        both, up = row[:-1] + s[i], row - GAP
        best = np.empty(m + 1)
        best[0] = up[0]
        best[1:] = np.maximum(both, up[1:])
        run = np.maximum.accumulate(best + gap) - gap
        step[i + 1, 1:] = np.where(run[1:] > best[1:] + 1e-9, 2, np.where(up[1:] > both, 1, 0))
        row = run
    a, b, i, j = [], [], n, m
    while i or j:
        k = step[i, j]
        a.append(i - 1 if k != 2 else -1)
        b.append(j - 1 if k != 1 else -1)
        i, j = i - (k != 2), j - (k != 1)
    return a[::-1], b[::-1]


def _spread(row: str, at: list[int]) -> str:
    return "".join("-" if k < 0 else row[k] for k in at)


def progressive(names: list[str], seqs: list[str]) -> dict[str, str]:
    """Aligned rows by name.  Sequences that are all equal are their own alignment."""
    if len({s.upper() for s in seqs}) <= 1:
        return dict(zip(names, seqs))
    d = np.array([[kmer_distance(a, b) for b in seqs] for a in seqs])
    own = dict(zip(names, seqs))
    done: dict[int, tuple[list[str], list[str]]] = {}
    for node in reversed(list(average_linkage(names, d).walk())):
        if not node.children:
            done[id(node)] = ([node.name], [own[node.name]])
            continue
        (na, ra), (nb, rb) = (done.pop(id(c)) for c in node.children)
        a, b = _trace(_profile(ra), _profile(rb))
        done[id(node)] = (na + nb, [_spread(r, a) for r in ra] + [_spread(r, b) for r in rb])
    (got, rows), *_ = done.values()
    return dict(zip(got, rows))


def distances(rows: list[str], model: str = "k2p") -> np.ndarray:
    """Pairwise distances of aligned rows over columns filled in both; at most 5."""
    c = np.stack([codes(r) for r in rows])
    n = len(rows)
    out = np.zeros((n, n))
    for i in range(n):
        both = (c[i] < 4) & (c < 4)
        sites = np.maximum(both.sum(axis=1), 1)
        differ = both & (c[i] != c)
        transit = (differ & ((c[i] + c) % 2 == 0)).sum(axis=1) / sites
        total = differ.sum(axis=1) / sites
        if model == "jc":
            x = 1 - 4 * total / 3
            d = np.where(x > 1e-3, -0.75 * np.log(np.maximum(x, 1e-3)), 5.0)
        else:
            a, b = 1 - 2 * transit - (total - transit), 1 - 2 * (total - transit)
            ok = (a > 1e-3) & (b > 1e-3)
            d = np.where(ok, -0.5 * np.log(np.maximum(a, 1e-3)) - 0.25 * np.log(np.maximum(b, 1e-3)), 5.0)
        out[i] = np.minimum(d, 5.0)
    np.fill_diagonal(out, 0)
    return (out + out.T) / 2


def balanced_length(distance: np.ndarray, tree: Node, names: list[str]) -> float:
    """Length of a tree under balanced minimum evolution (Pauplin's formula)."""
    from .trees import tip_steps

    steps = tip_steps(tree, names)
    if len(tree.children) == 2:  # two branches at the root are one
        left = {n: k for k, n in enumerate(names)}
        side = np.zeros(len(names), bool)
        side[[left[t] for t in tree.children[0].tips()]] = True
        steps = steps - (side[:, None] != side[None])
    weight = np.where(steps > 0, 2.0 ** (-steps), 0)
    return float((distance * weight).sum())


def local_align(gene: str, target: str, matrix: list[list[int]] | None = None, gap: float = 3.0) -> tuple[float, int, str, str]:
    """``(score, target start, aligned gene, aligned target)`` of the best local alignment."""
    if matrix is None:
        score = np.full((5, 5), MISMATCH)
        np.fill_diagonal(score, MATCH)
    else:
        score = np.full((5, 5), float(min(map(min, matrix))))
        score[:4, :4] = matrix
    score[4, :] = score[:, 4] = min(score.min(), -1)
    q, t = codes(gene), codes(target)
    if not len(q) or not len(t):
        return 0.0, 0, "", ""
    ramp = gap * np.arange(len(t) + 1)
    h = np.zeros((len(q) + 1, len(t) + 1))
    for i in range(len(q)):
        best = np.zeros(len(t) + 1)
        best[1:] = np.maximum(0, np.maximum(h[i, :-1] + score[q[i], t], h[i, 1:] - gap))
        h[i + 1] = np.maximum.accumulate(best + ramp) - ramp
    i, j = divmod(int(np.argmax(h)), len(t) + 1)
    top, a, b = float(h[i, j]), [], []
    while h[i, j] > 1e-9:
        if i and j and math.isclose(h[i, j], h[i - 1, j - 1] + score[q[i - 1], t[j - 1]], abs_tol=1e-6):
            a.append(gene[i - 1])
            b.append(target[j - 1])
            i, j = i - 1, j - 1
        elif i and math.isclose(h[i, j], h[i - 1, j] - gap, abs_tol=1e-6):
            a.append(gene[i - 1])
            b.append("-")
            i -= 1
        else:
            a.append("-")
            b.append(target[j - 1])
            j -= 1
    return top, j, "".join(reversed(a)), "".join(reversed(b))
