"""String similarity kernels: Jaro-Winkler and restricted edit distance.

``jaro_winkler`` is the greedy form: window max(len)/2 - 1, half of the
transposed matches (not rounded down), up to four common leading letters at
0.1 each and no minimum for that bonus. ``osa`` is the restricted
Damerau-Levenshtein distance. ``jaro_winkler_many`` computes one value for each
pair of two columns with numpy, looping over letter positions and not over pairs.
"""

from __future__ import annotations

import numpy as np


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used, left = [False] * lb, []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def osa(a: str, b: str) -> int:
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def letters(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(texts), width), dtype=np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.int32)
    return out, np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))


def jaro_winkler_many(left: list[str], right: list[str]) -> np.ndarray:
    """``jaro_winkler`` of each pair (left[k], right[k])."""
    if not left:
        return np.zeros(0)
    width = max(1, max(map(len, left)), max(map(len, right)))
    return jaro_winkler_codes(*letters(left, width), *letters(right, width))


def jaro_winkler_codes(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``jaro_winkler`` of each pair of rows of letters (zeros behind the end) with their lengths."""
    n, width = a.shape
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used = np.zeros((n, width), dtype=bool)
    hit = np.zeros((n, width), dtype=bool)
    for i in range(int(la.max())):
        live = i < la
        low, high = int(max(0, i - reach.max())), int(min(width, i + reach.max() + 1))
        for j in range(low, high):
            ok = live & ~hit[:, i] & (j < lb) & (np.abs(i - j) <= reach) & ~used[:, j] & (a[:, i] == b[:, j])
            used[:, j] |= ok
            hit[:, i] |= ok
    m = hit.sum(1)
    # The matched letters of both sides in order, packed to the left.
    order_a, order_b = np.argsort(~hit, axis=1, kind="stable"), np.argsort(~used, axis=1, kind="stable")
    ma, mb = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
    swaps = ((ma != mb) & (np.arange(width)[None, :] < m[:, None])).sum(1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / np.maximum(m, 1)) / 3, 0.0)
    prefix, going = np.zeros(n), np.ones(n, dtype=bool)
    for i in range(min(4, width)):
        going = going & (i < la) & (i < lb) & (a[:, i] == b[:, i])
        prefix += going
    same = np.all(a == b, axis=1) & (la == lb)
    return np.where(same, (la > 0).astype(float), np.where(m > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0))


def osa_many(left: list[str], right: list[str]) -> np.ndarray:
    """``osa`` of each pair."""
    n = len(left)
    if not n:
        return np.zeros(0, dtype=np.int64)
    width = max(1, max(map(len, left)), max(map(len, right)))
    a, la = letters(left, width)
    b, lb = letters(right, width)
    grid = np.zeros((width + 1, width + 1, n), dtype=np.int16)
    grid[:, 0, :] = np.arange(width + 1)[:, None]
    grid[0, :, :] = np.arange(width + 1)[:, None]
    for i in range(1, width + 1):
        for j in range(1, width + 1):
            differs = a[:, i - 1] != b[:, j - 1]
            best = np.minimum(np.minimum(grid[i - 1, j], grid[i, j - 1]) + 1, grid[i - 1, j - 1] + differs)
            if i > 1 and j > 1:
                crossed = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(crossed, np.minimum(best, grid[i - 2, j - 2] + 1), best)
            grid[i, j] = best
    return grid[la, lb, np.arange(n)].astype(np.int64)
