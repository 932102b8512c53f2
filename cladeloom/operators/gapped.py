"""Local alignment with affine gaps of many gene and window pairs at once.

All pairs of a block advance through their tables row by row together, and are traced back together, so
the work per pair is done by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.msa import codes

CELLS = 1 << 24
_FAR = -(1 << 28)


def scores(matrix: list[list[float]] | None, match: int, mismatch: int) -> np.ndarray:
    """Scores of base codes; an ambiguous base (4) scores 0 against any, padding (5) ends an alignment."""
    out = np.zeros((6, 6), np.int32)
    if matrix is None:
        out[:4, :4] = mismatch
        np.fill_diagonal(out[:4, :4], match)
    else:
        out[:4, :4] = matrix
    out[5, :] = out[:, 5] = _FAR
    return out


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), 5, np.uint8)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _block(genes: list[str], windows: list[str], table: np.ndarray, start: int, step: int) -> list[tuple[int, int, str, str]]:
    q, t = _padded([codes(g) for g in genes]), _padded([codes(w) for w in windows])
    b, n, m = len(genes), q.shape[1], t.shape[1]
    came = np.zeros((n, b, m), np.uint8)  # 0 begin, 1 both, 2 gene against a gap, 3 a gap against the window; 4, 8: that gap goes on
    above = np.zeros((b, m + 1), np.int32)
    down = np.full((b, m), _FAR, np.int32)
    ramp = (step * np.arange(m + 1)).astype(np.int32)
    top, top_i, top_j = np.zeros(b, np.int32), np.full(b, -1), np.zeros(b, np.int64)
    for i in range(n):
        opened, on = above[:, 1:] - (start + step), down - step
        down = np.maximum(opened, on)
        both = above[:, :-1] + table[q[:, i, None], t]
        best = np.maximum(np.maximum(both, down), 0)
        # a gap along the window: the highest earlier cell less the way from there
        run = np.concatenate([np.zeros((b, 1), np.int32), best], axis=1) + ramp
        across = np.maximum.accumulate(run, axis=1)[:, :-1] - ramp[1:] - start
        here = np.maximum(best, across)
        kind = np.where(here <= 0, 0, np.where(here == both, 1, np.where(here == down, 2, 3))).astype(np.uint8)
        kind |= (on > opened).astype(np.uint8) << 2
        kind[:, 1:] |= (across[:, :-1] - step > best[:, :-1] - start - step).astype(np.uint8) << 3
        came[i] = kind
        at = here.argmax(axis=1)
        high = here[np.arange(b), at]
        better = high > top
        top[better], top_i[better], top_j[better] = high[better], i, at[better]
        above[:, 1:] = here
    i, j, state = top_i.copy(), top_j.copy(), np.zeros(b, np.int64)
    path: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(i >= 0)
    while len(live):
        c = came[i[live], live, j[live]]
        s = np.where(state[live] > 0, state[live], c & 3)
        go = s > 0
        live, c, s = live[go], c[go], s[go]
        if not len(live):
            break
        path.append((live, s))
        state[live] = np.where((s == 2) & (c & 4 > 0), 2, np.where((s == 3) & (c & 8 > 0), 3, 0))
        i[live] -= s != 3
        j[live] -= s != 2
        live = live[(i[live] >= 0) & (j[live] >= 0)]
    moves: list[list[int]] = [[] for _ in range(b)]
    for who, s in path:
        for k, x in zip(who.tolist(), s.tolist()):
            moves[k].append(x)
    out = []
    for k in range(b):
        gi, wj, a, w = int(i[k]) + 1, int(j[k]) + 1, [], []
        first = wj
        for x in reversed(moves[k]):
            a.append("-" if x == 3 else genes[k][gi])
            w.append("-" if x == 2 else windows[k][wj])
            gi += x != 3
            wj += x != 2
        out.append((int(top[k]), first, "".join(a), "".join(w)))
    return out


def local_alignments(genes: list[str], windows: list[str], matrix: list[list[float]] | None = None, start: int = 4, step: int = 2, match: int = 2, mismatch: int = -2) -> Iterator[tuple[int, int, str, str]]:
    """``(score, window start, aligned gene, aligned window)`` of each pair's best local alignment, in order.

    A gap of n bases costs ``start + n * step``.  A pair without any score has empty rows.  Blocks hold at
    most ``CELLS`` cells.
    """
    table = scores(matrix, match, mismatch)
    if start < 0 or step <= 0:
        raise ValueError("gaps cost something")
    lo = 0
    while lo < len(genes):
        hi, n, m = lo, 1, 1
        while hi < len(genes):
            n2, m2 = max(n, len(genes[hi])), max(m, len(windows[hi]))
            if hi > lo and (hi - lo + 1) * n2 * m2 > CELLS:
                break
            hi, n, m = hi + 1, n2, m2
        yield from _block([g or "-" for g in genes[lo:hi]], [w or "-" for w in windows[lo:hi]], table, start, step)
        lo = hi

