"""Arithmetic of the prime field with p = 2**61 - 1 on numpy uint64 arrays.

Used inside tasks only: Spark groups the hashes into small buckets, and these helpers treat all
buckets of one Arrow batch at once.
"""

from __future__ import annotations

import random

import numpy as np

P = (1 << 61) - 1
#: Elements lie below this bound, evaluation points above it, so no point is a root.
ELEMENTS = 1 << 60
_P = np.uint64(P)
_M30, _M31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61, _1 = np.uint64(30), np.uint64(31), np.uint64(61), np.uint64(1)


def points(count: int) -> np.ndarray:
    """Evaluation points; a shorter list is a prefix of a longer one."""
    rng = random.Random(20240229)
    return np.array([rng.randrange(ELEMENTS, P) for _ in range(count)], np.uint64)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a1, a0, b1, b0 = a >> _31, a & _M31, b >> _31, b & _M31
    mid = a1 * b0 + a0 * b1
    t = ((a1 * b1) << _1) + (mid >> _30) + ((mid & _M30) << _31) + a0 * b0
    t = (t & _P) + (t >> _61)
    return np.where(t >= _P, t - _P, t)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a + b
    return np.where(t >= _P, t - _P, t)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return add(a, _P - b)


def power(a: np.ndarray, e: int) -> np.ndarray:
    out, base = np.ones_like(a), a
    while e:
        if e & 1:
            out = mul(out, base)
        e >>= 1
        if e:
            base = mul(base, base)
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    return power(a, P - 2)


def characteristic(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows: lists of elements; columns: their polynomial prod(z - x) at each point z."""
    sizes = np.diff(offsets)
    out = np.ones((len(sizes), len(at)), np.uint64)
    if not len(values):
        return out
    width = 1 << int(max(1, sizes.max()) - 1).bit_length()
    step = max(1, 2_000_000 // width)
    for lo in range(0, len(sizes), step):
        n = sizes[lo : lo + step]
        filled = np.arange(width)[None, :] < n[:, None]
        x = values[offsets[lo] : offsets[lo + len(n)]].astype(np.uint64)
        for j, z in enumerate(at):
            grid = np.ones(filled.shape, np.uint64)
            grid[filled] = sub(np.full(len(x), z), x)
            while grid.shape[1] > 1:
                grid = mul(grid[:, 0::2], grid[:, 1::2])
            out[lo : lo + len(n), j] = grid[:, 0]
    return out


def _solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many square systems, and which of them had one only."""
    count, n = b.shape
    m = np.concatenate([a, b[:, :, None]], axis=2)
    good, rows = np.ones(count, bool), np.arange(count)
    for c in range(n):
        pivot = c + np.argmax(m[:, c:, c] != 0, axis=1)
        good &= m[rows, pivot, c] != 0
        swap = m[rows, pivot].copy()
        m[rows, pivot] = m[:, c]
        m[:, c] = mul(swap, inverse(swap[:, c])[:, None])
        for r in range(n):
            if r != c:
                m[:, r] = sub(m[:, r], mul(m[:, c], m[:, r, c][:, None].copy()))
    return m[:, :, n], good


def _at(coefficients: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Monic polynomials (rows, lowest coefficient first) at the points z."""
    out = np.ones((len(coefficients), len(z)), np.uint64)
    for k in range(coefficients.shape[1] - 1, -1, -1):
        out = add(mul(out, z[None, :]), coefficients[:, k][:, None])
    return out


def _gcd(a: list[int], b: list[int]) -> list[int]:
    """Monic greatest common divisor of polynomials, lowest coefficient first."""
    while b:
        lead = pow(b[-1], -1, P)
        b = [x * lead % P for x in b]
        while len(a) >= len(b):
            q, shift = a[-1], len(a) - len(b)
            a = [(x - q * b[i - shift]) % P if i >= shift else x for i, x in enumerate(a)][:-1]
            while a and not a[-1]:
                a.pop()
        a, b = b, a
    return a


def _quotient(a: list[int], b: list[int]) -> list[int]:
    out = [0] * (len(a) - len(b) + 1)
    a = list(a)
    for shift in range(len(out) - 1, -1, -1):
        out[shift] = q = a[shift + len(b) - 1]
        for i, x in enumerate(b):
            a[shift + i] = (a[shift + i] - q * x) % P
    return out


def _times(a: np.ndarray, b: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Products of polynomials below degree d modulo the monic f of degree d, for many rows."""
    d = f.shape[1]
    full = np.zeros((len(f), 2 * d - 1), np.uint64)
    for i in range(d):
        full[:, i : i + d] = add(full[:, i : i + d], mul(b, a[:, i][:, None]))
    for k in range(2 * d - 2, d - 1, -1):
        full[:, k - d : k] = sub(full[:, k - d : k], mul(f, full[:, k][:, None]))
    return full[:, :d]


def roots(f: np.ndarray, seed: int = 1) -> list[list[int] | None]:
    """All roots of monic polynomials of one degree (rows, lowest coefficient first); None if one doesn't split into different linear factors."""
    count, d = f.shape
    if d == 0:
        return [[] for _ in range(count)]
    if d == 1:
        return [[int(x)] for x in sub(np.zeros(count, np.uint64), f[:, 0])]
    if d == 2:
        half = np.uint64(pow(2, -1, P))
        b = mul(f[:, 1], np.full(count, half))
        disc = sub(mul(b, b), f[:, 0])
        s = power(disc, (P + 1) // 4)
        ok = (mul(s, s) == disc) & (disc != 0)
        return [[int(x), int(y)] if g else None for x, y, g in zip(sub(s, b), sub(sub(np.zeros_like(s), s), b), ok)]
    out: list[list[int] | None] = [[] for _ in range(count)]
    todo, rng = [(i, [int(x) for x in row] + [1]) for i, row in enumerate(f)], random.Random(seed)
    for _ in range(80):
        by: dict[int, list[tuple[int, list[int]]]] = {}
        for i, g in todo:
            if out[i] is not None:
                by.setdefault(len(g) - 1, []).append((i, g))
        todo = []
        for degree, own in by.items():
            low = np.array([g[:-1] for _, g in own], np.uint64)
            if degree <= 2:
                for (i, _), r in zip(own, roots(low)):
                    out[i] = None if r is None or out[i] is None else out[i] + r
                continue
            base = np.zeros((len(own), degree), np.uint64)
            base[:, 0], base[:, 1] = rng.randrange(P), 1
            y = base
            for _ in range(59):
                y = _times(_times(y, y, low), base, low)
            y[:, 0] = sub(y[:, 0], np.ones(len(own), np.uint64))
            for (i, g), h in zip(own, y):
                h = [int(x) for x in h]
                while h and not h[-1]:
                    h.pop()
                part = _gcd(g, h) if h else g
                if 1 < len(part) < len(g):
                    todo += [(i, part), (i, _quotient(g, part))]
                else:
                    todo.append((i, g))
        if not todo:
            break
    for i, _ in todo:
        out[i] = None
    return [None if r is None or len(set(r)) != d else r for r in out]


def difference(na: np.ndarray, nb: np.ndarray, ea: np.ndarray, eb: np.ndarray, at: np.ndarray, spare: int) -> list[tuple[list[int], list[int]] | None]:
    """Elements that only the first, only the second set has, for each row; None where the bound is too low.

    ``ea`` and ``eb`` hold the sets' characteristic polynomials at the points ``at``. The smallest
    rational function that agrees at all points is sought; at least ``spare`` points take no part in
    solving and verify it.
    """
    out: list[tuple[list[int], list[int]] | None] = [None] * len(na)
    ratio = mul(ea, inverse(eb.ravel()).reshape(eb.shape))
    left, d = np.arange(len(na)), na.astype(np.int64) - nb.astype(np.int64)
    for total in range(len(at) - spare + 1):
        now = left[(np.abs(d[left]) <= total) & ((d[left] - total) % 2 == 0)]
        for diff in np.unique(d[now]):
            rows = now[d[now] == diff]
            da, db = (total + int(diff)) // 2, (total - int(diff)) // 2
            for lo in range(0, len(rows), step := max(1, 200_000 // max(1, total * total))):
                own = rows[lo : lo + step]
                f = ratio[own]
                if total:
                    z = at[:total]
                    zp = [np.ones_like(z)]
                    for _ in range(max(da, db)):
                        zp.append(mul(zp[-1], z))
                    g = f[:, :total]
                    columns = [np.broadcast_to(zp[k], g.shape) for k in range(da)] + [sub(np.zeros_like(g), mul(g, zp[k][None, :])) for k in range(db)]
                    x, good = _solve(np.stack(columns, axis=2), sub(mul(g, zp[db][None, :]), np.broadcast_to(zp[da], g.shape)))
                    pa, pb = x[:, :da], x[:, da:]
                else:
                    good, pa, pb = np.ones(len(own), bool), np.zeros((len(own), 0), np.uint64), np.zeros((len(own), 0), np.uint64)
                good &= (_at(pa, at) == mul(f, _at(pb, at))).all(axis=1)
                hit = np.flatnonzero(good)
                for i, ra, rb in zip(hit, roots(pa[hit]), roots(pb[hit])):
                    if ra is not None and rb is not None and max([*ra, *rb, 0]) < ELEMENTS:
                        out[own[i]] = (ra, rb)
        left = np.array([i for i in left if out[i] is None], np.int64)
        if not len(left):
            break
    return out
