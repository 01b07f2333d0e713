"""Column-wise construction over collections of aligned contexts.

Each round inserts one symbol of every context. The order of all contexts by what has been inserted so far, and the common
prefix of each with its neighbour, follow from those of the round before: a stable sort by the new symbol keeps the order
among equal symbols, and the common prefix of two that become neighbours is the least of those between them. This
is how a Burrows-Wheeler transform of a collection is built column by column; the contexts of a group all hold one seed at
one place, so only suffixes of one column ever need to be compared.
"""

from __future__ import annotations

import numpy as np


def least_between(x: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """min(x[p + 1 .. q]) for p < q."""
    out = x[q]
    far = np.flatnonzero(q - p > 1)
    if not len(far):
        return out
    p, q = p[far] + 1, q[far]
    level = np.frexp((q - p + 1).astype(np.float64))[1] - 1
    table, least = x, np.empty(len(far), x.dtype)
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[: len(table) - (1 << k - 1)], table[1 << k - 1 :])
        at = np.flatnonzero(level == k)
        least[at] = np.minimum(table[p[at]], table[q[at] - (1 << k) + 1])
    out[far] = least
    return out


def inserted(order: np.ndarray, common: np.ndarray, group: np.ndarray, symbol: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes after a round.

    order: contexts by group, then by what has been inserted; common: each one's common prefix with the one before it,
    -1 where there is none. symbol: each context's, 0 for none. new: by how much an equal symbol lengthens it; with 0,
    contexts with other symbols have nothing in common any more (-1).
    """
    key = group[order] * (int(symbol.max(initial=0)) + 1) + symbol[order]
    if (key[1:] >= key[:-1]).all():
        move, k, least = None, key, common[1:]
    else:
        move = np.argsort(key, kind="stable")
        k = key[move]
    same = k[1:] == k[:-1]
    if move is not None:
        order = order[move]
        least = np.full(len(same), -1, common.dtype)
        least[same] = least_between(common, move[:-1][same], move[1:][same])
    g = group[order]
    other = np.where(g[1:] == g[:-1], 0 if new else -1, -1)
    none = symbol[order][1:] == 0
    out = np.full(len(order), -1, common.dtype)
    out[1:] = np.where(same & ~none, least + new, other)
    return order, out


def _dense(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as numbers from 1 on; 0 where there is none."""
    j = np.arange(a.shape[1])
    ha, hb = j < na[:, None], j < nb[:, None]
    if a.dtype == np.uint8:
        return np.where(ha, a.astype(np.int64) + 1, 0), np.where(hb, b.astype(np.int64) + 1, 0)
    _, back = np.unique(np.concatenate([a[ha], b[hb]]), return_inverse=True)
    out = np.zeros(a.shape, np.int64), np.zeros(b.shape, np.int64)
    out[0][ha], out[1][hb] = back[: int(ha.sum())] + 1, back[int(ha.sum()) :] + 1
    return out


def repeated_windows(group: np.ndarray, left: np.ndarray, nl: np.ndarray, right: np.ndarray, nr: np.ndarray, ids: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that several contexts of a group share, as runs (context, first, last) of their symbols on the left.

    left, right: up to `reach` symbols on either side of a group's seed, from the seed outwards, and how many there are.
    A window holds the seed, some symbols on the left, and the rest of `reach` on the right. ids: only a window that
    a context with a smaller id holds counts as a repeat; None: every shared one does.
    """
    n, reach = left.shape
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    left, right = _dense(left, nl, right, nr)
    order = np.argsort(group, kind="stable")
    g = group[order]
    common = np.where(np.append(False, g[1:] == g[:-1]), 0, -1).astype(np.int32)
    for j in range(reach - 1, -1, -1):
        order, common = inserted(order, common, group, right[:, j], 1)
    hit = np.zeros((n, reach + 3), bool)  # a column of False on either side
    for k in range(reach + 1):
        head = common < reach - k
        at = np.flatnonzero(head)
        run = np.cumsum(head) - 1
        if ids is None:
            again = np.diff(np.append(at, n))[run] > 1
        else:
            again = ids[order] > np.minimum.reduceat(ids[order], at)[run]
        hit[order[again], k + 1] = True
        if k < reach:
            order, common = inserted(order, common, group, left[:, k], 0)
    change = hit[:, 1:] != hit[:, :-1]
    rows, edge = np.nonzero(change)
    return rows[::2], edge[::2], edge[1::2] - 1
