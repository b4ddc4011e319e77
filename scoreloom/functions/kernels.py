"""Pure numpy kernels: assignment, grid alignment, tree edit distance, string ratios. They see one bounded group each and no Spark."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of a rectangular matrix by shortest augmenting paths with potentials; of equal costs the smaller index first."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        reach, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, i, last = -1, row, 0.0
        while True:
            rest = ~done
            through = last + cost[i] - u[i] - v
            better = rest & (through < reach - 1e-15)
            reach[better], before[better] = through[better], at
            at = int(np.where(rest, reach, np.inf).argmin())
            last, done[at] = reach[at], True
            if owner[at] < 0:
                break
            i = owner[at]
        seen = done & (owner >= 0)
        u[row] += last
        u[owner[seen]] += last - reach[seen]
        v[done] -= last - reach[done]
        while at >= 0:
            owner[at] = owner[before[at]] if before[at] >= 0 else row
            at = before[at]
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0)


@lru_cache(maxsize=1 << 16)
def lcs_length(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            keep, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
            left = keep
    return row[-1]


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (|a| + |b|); both empty is 1."""
    return 1.0 if not a and not b else 2 * lcs_length(a, b) / (len(a) + len(b))


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(mine, (y for y, k in zip(b, used, strict=True) if k), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * scale * (1 - jaro)


def align_sequences(reward: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Best monotone alignment; of equal totals the diagonal, then the step past a true element, then past a predicted one."""
    n, m = reward.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1] + reward[i - 1, j - 1], best[i - 1, j], best[i, j - 1])
    pairs, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j - 1] + reward[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return float(best[n, m]), pairs[::-1]


def indel_ratios(a: list[str], b: list[str], longest: int = 48) -> np.ndarray:
    """``indel_ratio`` of every pair, one numpy step for each pair of places; distinct strings count once, long ones go one by one."""
    ua, ia = np.unique(np.array(a, object).astype(str), return_inverse=True)
    ub, ib = np.unique(np.array(b, object).astype(str), return_inverse=True)
    out = np.zeros((len(ua), len(ub)))
    long_a, long_b = np.char.str_len(ua) > longest, np.char.str_len(ub) > longest
    short_a, short_b = np.flatnonzero(~long_a), np.flatnonzero(~long_b)
    if len(short_a) and len(short_b):
        code = lambda u, pad: np.array([[*map(ord, x), *[pad] * (longest - len(x))] for x in u], np.int32)[:, : max(1, max(map(len, u)))]
        ca, cb = code(ua[short_a], -1), code(ub[short_b], -2)
        best = np.zeros((cb.shape[1] + 1, len(ca), len(cb)), np.int16)
        for x in range(ca.shape[1]):
            left = np.zeros((len(ca), len(cb)), np.int16)
            for y in range(cb.shape[1]):
                keep = best[y + 1].copy()
                np.maximum(best[y + 1], best[y], out=best[y + 1])
                np.maximum(best[y + 1], left + (ca[:, x, None] == cb[None, :, y]), out=best[y + 1])
                left = keep
        size = np.char.str_len(ua[short_a])[:, None] + np.char.str_len(ub[short_b])[None]
        out[np.ix_(short_a, short_b)] = np.where(size > 0, 2 * best[-1] / np.maximum(size, 1), 1.0)
    for x in range(len(ua)):
        for y in np.flatnonzero(long_a[x] | long_b):
            out[x, y] = indel_ratio(str(ua[x]), str(ub[y]))
    return out[ia][:, ib]


@lru_cache(maxsize=1 << 17)
def block_ratio(a: str, b: str) -> float:
    """2 * signs in matching blocks (the longest common one, then those to its left and right) / all signs; both empty is 1."""
    return SequenceMatcher(None, a, b).ratio()


def _longest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, last place in x, last place in y) of the longest common block of each column, the first of equals in x, then in y."""
    n = x.shape[1]
    best, ex, ey = (np.zeros(n, np.int8) for _ in range(3))
    row = np.zeros((len(y) + 1, n), np.int8)  # lengths of common suffixes, behind a row of zeros
    for i in range(len(x)):
        k = (row[:-1] + np.int8(1)) * (y == x[i])
        row[1:] = k
        most = k.max(axis=0)
        more = most > best
        if more.any():
            np.copyto(ey, k.argmax(axis=0), where=more, casting="unsafe")
            np.copyto(best, most, where=more)
            np.copyto(ex, i, where=more)
    return best, ex, ey


def _in_blocks(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Signs in matching blocks of each pair: the longest common block, then the same before it and after it. ``x``, ``y``: codes, a row a pair."""
    total, own = np.zeros(len(x), np.int64), np.arange(len(x))
    x0, x1, y0, y1 = np.zeros(len(x), np.int64), nx, np.zeros(len(x), np.int64), ny
    while len(own):
        at, to = np.arange(int(x1.max()))[:, None], np.arange(int(y1.max()))[:, None]
        side = lambda z, place, low, high, pad: np.where((place >= low) & (place < high), z[own, : len(place)].T, pad)
        best, ex, ey = (v.astype(np.int64) for v in _longest(side(x, at, x0, x1, -1), side(y, to, y0, y1, -2)))
        total += np.bincount(own, best, len(total)).astype(np.int64)
        parts = (x0, ex - best + 1, y0, ey - best + 1), (ex + 1, x1, ey + 1, y1)
        fit = [(best > 0) & (p[0] < p[1]) & (p[2] < p[3]) for p in parts]
        own, (x0, x1, y0, y1) = np.concatenate([own[f] for f in fit]), (np.concatenate([p[k][f] for p, f in zip(parts, fit, strict=True)]) for k in range(4))
    return total


#: Signs of a short text, pairs that are worth a step together, and pairs in one.
SHORT, FEW, PAIRS = 40, 64, 20_000


def block_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``block_ratio`` of every pair. Two signs in common subsequence or more are where it can differ from ``indel_ratio``, below 200 signs.

    Pairs of short texts take their blocks together, one numpy step for each pair of places; pairs with a long one go one by one.
    """
    out = indel_ratios(a, b)
    na, nb = (np.array([len(x) for x in side]) for side in (a, b))
    size = na[:, None] + nb[None]
    same = np.array(a, object)[:, None] == np.array(b, object)[None]
    unsure = (out * size > 3) & ~same
    coded = lambda side, wide: np.array([[*map(ord, x[:wide]), *[-1] * (wide - len(x))] for x in side], np.int32)
    for least, most in ((0, 8), (8, 16), (16, SHORT)):
        longer = np.maximum(na[:, None], nb[None])
        i, j = np.nonzero(unsure & (longer > least) & (longer <= most))
        if len(i) >= FEW:
            ca, cb = coded(a, most), coded(b, most)
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                out[p, q] = 2 * _in_blocks(ca[p], cb[q], na[p], nb[q]) / size[p, q]
            unsure[i, j] = False
    matcher = SequenceMatcher(None)
    for j in np.flatnonzero(unsure.any(axis=0)):
        matcher.set_seq2(b[j])
        seen: dict[str, float] = {}
        for i in np.flatnonzero(unsure[:, j]):
            if a[i] not in seen:
                matcher.set_seq1(a[i])
                seen[a[i]] = matcher.ratio()
            out[i, j] = seen[a[i]]
    return out


def edit_shares(a: list[str], b: list[str], longest: int = 48) -> np.ndarray:
    """Edit distance / the longer length of every pair (0 for two empty texts), one numpy step for each pair of places; long texts go one by one."""
    from .prose import edit_distance

    ua, ia = np.unique(np.array(a, object).astype(str), return_inverse=True)
    ub, ib = np.unique(np.array(b, object).astype(str), return_inverse=True)
    na, nb = np.char.str_len(ua), np.char.str_len(ub)
    out = np.zeros((len(ua), len(ub)))
    sa, sb = np.flatnonzero(na <= longest), np.flatnonzero(nb <= longest)
    if len(sa) and len(sb):
        code = lambda u, pad: np.array([[*map(ord, x), *[pad] * (longest - len(x))] for x in u], np.int32)[:, : max(1, max(map(len, u)))]
        ca, cb = code(ua[sa], -1), code(ub[sb], -2)
        row = [np.full((len(sa), len(sb)), y, np.int16) for y in range(cb.shape[1] + 1)]
        found = np.where(na[sa][:, None] == 0, nb[sb][None], 0).astype(np.int16)
        for x in range(ca.shape[1]):
            left, row[0] = row[0], np.full((len(sa), len(sb)), x + 1, np.int16)
            for y in range(cb.shape[1]):
                keep = row[y + 1]
                row[y + 1] = np.minimum(np.minimum(row[y + 1], row[y]) + 1, left + (ca[:, x, None] != cb[None, :, y]))
                left = keep
            for at in np.flatnonzero(na[sa] == x + 1):  # texts that end here
                found[at] = np.array([row[n][at, k] for k, n in enumerate(nb[sb])])
        out[np.ix_(sa, sb)] = found / np.maximum(np.maximum(na[sa][:, None], nb[sb][None]), 1)
    for x in range(len(ua)):
        for y in np.flatnonzero((na[x] > longest) | (nb > longest)):
            out[x, y] = edit_distance(str(ua[x]), str(ub[y])) / max(na[x], nb[y])
    return out[ia][:, ib]


def aligned_totals(reward: np.ndarray) -> np.ndarray:
    """The best monotone alignment's total of each matrix in the last two dimensions."""
    n, m = reward.shape[-2:]
    row = [np.zeros(reward.shape[:-2]) for _ in range(m + 1)]
    for i in range(n):
        left = row[0]
        for j in range(1, m + 1):
            keep = row[j]
            row[j] = np.maximum(np.maximum(row[j], row[j - 1]), left + reward[..., i, j - 1])
            left = keep
    return row[m]


def grid_similarity(true: list[list[str]], predicted: list[list[str]]) -> dict:
    """Factored two-dimensional most similar substructures: rows and columns are aligned apart, cells where both are."""
    rows, cols = (len(true), len(predicted)), (len(true[0]) if true else 0, len(predicted[0]) if predicted else 0)
    if not rows[0] * cols[0] or not rows[1] * cols[1]:
        return {"f": float(rows[0] * cols[0] == rows[1] * cols[1]), "rows": [], "cols": []}
    flat = block_ratios([c for r in true for c in r], [c for r in predicted for c in r])
    cell = flat.reshape(rows[0], cols[0], rows[1], cols[1]).transpose(0, 2, 1, 3)
    row_pairs = align_sequences(aligned_totals(cell))[1]
    col_pairs = align_sequences(aligned_totals(cell.transpose(2, 3, 0, 1)))[1]
    total = sum(cell[i, k, j, m] for i, k in row_pairs for j, m in col_pairs)
    p, r = total / (rows[1] * cols[1]), total / (rows[0] * cols[0])
    return {"f": 2 * p * r / (p + r) if p and r else 0.0, "rows": row_pairs, "cols": col_pairs}


def tree_distance(a: tuple, b: tuple, rename=lambda x, y: float(x != y)) -> float:
    """Zhang and Shasha's edit distance of ordered trees (label, [children]); inserting and deleting cost 1."""

    def laid(tree: tuple) -> tuple[list, list[int], list[int]]:
        labels, left = [], []

        def visit(node: tuple) -> int:
            first = None
            for child in node[1]:
                x = visit(child)
                first = x if first is None else first
            labels.append(node[0])
            left.append(len(labels) - 1 if first is None else first)
            return left[-1]

        visit(tree)
        return labels, left, sorted({v: i for i, v in enumerate(left)}.values())

    (la, lefts_a, keys_a), (lb, lefts_b, keys_b) = laid(a), laid(b)
    tree = np.zeros((len(la), len(lb)))
    for i in keys_a:
        for j in keys_b:
            x, y = lefts_a[i], lefts_b[j]
            forest = np.zeros((i - x + 2, j - y + 2))
            forest[:, 0], forest[0, :] = np.arange(i - x + 2), np.arange(j - y + 2)
            for p in range(x, i + 1):
                for q in range(y, j + 1):
                    s, t = p - x + 1, q - y + 1
                    step = min(forest[s - 1, t], forest[s, t - 1]) + 1
                    if lefts_a[p] == x and lefts_b[q] == y:
                        forest[s, t] = tree[p, q] = min(step, forest[s - 1, t - 1] + rename(la[p], lb[q]))
                    else:
                        forest[s, t] = min(step, forest[lefts_a[p] - x, lefts_b[q] - y] + tree[p, q])
    return float(tree[-1, -1])


def greedy_match(iou: np.ndarray, scores: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """By falling score, each prediction takes the free true box of the largest IoU at or above the threshold; -1 if none."""
    free, out = np.ones(iou.shape[1], bool), np.full(iou.shape[0], -1)
    for p in np.argsort(-scores, kind="stable"):
        row = np.where(free, iou[p], -1.0)
        if len(row) and row.max() >= threshold:
            out[p] = int(row.argmax())
            free[out[p]] = False
    return out


def average_precision(hits: np.ndarray, n_true: int) -> float:
    """Sum of precision at each hit over the number of true ones; ``hits`` by falling score."""
    rank = np.arange(1, len(hits) + 1)
    return float((np.cumsum(hits) / rank * hits).sum() / n_true) if n_true else 0.0
