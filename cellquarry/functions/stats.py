"""Statistics without a counterpart in Spark SQL (numpy)."""

from __future__ import annotations

from math import lgamma

import numpy as np

_lgamma = np.vectorize(lgamma, otypes=[float])


def log_t_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """log P(T <= t) of Student's t, exact far into the tail (continued fraction of the incomplete beta function)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(all="ignore"):
        x = df / (df + t * t)
        tail = _log_beta_inc(df / 2, np.full_like(df, 0.5), x) - np.log(2)  # log P(T > |t|)
        out = np.where(t <= 0, tail, np.log1p(-np.exp(tail)))
    return np.where(np.isnan(t) | np.isnan(df), np.nan, out)


def _log_beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-15:
            break
    front = p * np.log(z) + q * np.log1p(-z) - np.log(p) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q))
    out = front + np.log(h)
    return np.where(x <= 0, -np.inf, np.where(x >= 1, 0.0, np.where(swap, np.log1p(-np.exp(np.minimum(out, 0.0))), out)))


def log_bh(logp: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg in logs; nan stays nan and does not count."""
    out = np.full(len(logp), np.nan)
    ok = np.flatnonzero(~np.isnan(logp))
    order = ok[np.argsort(logp[ok], kind="stable")]
    n = len(order)
    out[order] = np.minimum(np.minimum.accumulate((logp[order] + np.log(n / np.arange(1, n + 1)))[::-1])[::-1], 0.0)
    return out


def log_simes(logp: np.ndarray) -> float:
    """Simes' combination of p-values, in logs."""
    own = np.sort(logp[~np.isnan(logp)])
    return float(np.min(own + np.log(len(own) / np.arange(1, len(own) + 1)))) if len(own) else float("nan")


def neighbours(n: int, span: float, degree: int = 2) -> int:
    """How many of n points a local fit takes."""
    return max(min(int(np.floor(n * span + 1e-9)), n), min(degree + 1, n))


def loess_counted(x: np.ndarray, y: np.ndarray, times: np.ndarray, alone: np.ndarray, span: float, at: slice, degree: int = 2) -> np.ndarray:
    """loess() at the places ``at`` of distinct, ascending x that stand for ``times`` points each, with mean y.

    A place of which only some points are among the nearest is as far as the farthest and weighs nothing, so whole places do.
    ``alone``: the fit where all of the nearest stand at one place.
    """
    upto = np.cumsum(times)
    n = int(upto[-1])
    k = neighbours(n, span, degree)
    places = x[at]
    low, high = np.zeros(len(places), np.int64), np.full(len(places), n - k, np.int64)
    value = lambda j: x[np.searchsorted(upto, j, side="right")]
    while (todo := low < high).any():  # the least first point beyond which the next one is no nearer
        mid = (low + high) // 2
        on = value(np.minimum(mid + k, n - 1)) - places < places - value(mid)
        low, high = np.where(todo & on, mid + 1, low), np.where(todo & ~on, mid, high)
    first, last = np.searchsorted(upto, low, side="right"), np.searchsorted(upto, low + k - 1, side="right")
    out = np.empty(len(places))
    for i, v in enumerate(places.tolist()):
        own = slice(int(first[i]), int(last[i]) + 1)
        far = max(v - x[own.start], x[own.stop - 1] - v) * max(span, 1.0)
        if far <= 0:
            out[i] = alone[at.start + i]
            continue
        unit = (x[own] - v) / far
        w = np.clip(1 - np.abs(unit) ** 3, 0, None) ** 3 * times[own]
        basis = np.vander(unit, degree + 1, increasing=True)
        weighted = basis * w[:, None]
        out[i] = np.linalg.lstsq(basis.T @ weighted, weighted.T @ y[own], rcond=None)[0][0]
    return out


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.75, degree: int = 2, at: np.ndarray | None = None) -> np.ndarray:
    """Local regression with tricube weights, fitted at every x, or at the places ``at``."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    k = neighbours(n, span, degree)
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    places = x if at is None else np.asarray(at, float)
    where, lo, out = np.argsort(places, kind="stable"), 0, np.empty(len(places))
    for i in where.tolist():
        v = places[i]
        while lo + k < n and xs[lo + k] - v < v - xs[lo]:
            lo += 1
        own = slice(lo, lo + k)
        far = max(v - xs[lo], xs[lo + k - 1] - v) * max(span, 1.0)
        dist = xs[own] - v
        w = np.clip(1 - (np.abs(dist) / far if far > 0 else np.zeros(k)) ** 3, 0, None) ** 3
        if not degree:
            out[i] = np.average(ys[own], weights=w)
            continue
        unit = dist / (far if far > 0 else 1.0)
        basis = np.vander(unit, degree + 1, increasing=True)
        weighted = basis * w[:, None]
        out[i] = np.linalg.lstsq(basis.T @ weighted, weighted.T @ ys[own], rcond=None)[0][0]
    return out


def damped_shares(a: np.ndarray, b: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Non-negative weights of a's columns that make up b, by damped weighted least squares, scaled to 1."""
    x = nnls(a, b)
    for _ in range(rounds):
        w = 1 / np.maximum(a @ x, 1e-3)
        w = np.minimum(w / w.min(), 100.0)
        old, x = x, nnls(a * w[:, None], b * w)
        if np.abs(x - old).max(initial=0) < 1e-6:
            break
    return x / x.sum() if x.sum() > 0 else x


def damped_shares_of_kinds(a: np.ndarray, times: np.ndarray, b: np.ndarray, rounds: int = 10) -> np.ndarray:
    """damped_shares() of many cells at once, over kinds of equal rows: ``a`` kinds x types, ``times`` how often each occurs, ``b`` cells x kinds sums of a cell's values.

    Rows of zeros may be left out: they add nothing to the sums, and their weight is never the least.
    """
    flat = (a * times[:, None]).T @ a
    x = nnls_many(np.broadcast_to(flat, (len(b), *flat.shape)), b @ a)
    todo = np.arange(len(b))
    for _ in range(rounds):
        w = 1 / np.maximum(x[todo] @ a.T, 1e-3)
        w = np.minimum(w / w.min(axis=1, keepdims=True), 100.0) ** 2
        new = nnls_many(np.einsum("cr,ri,rj->cij", w * times, a, a, optimize=True), (w * b[todo]) @ a)
        moved = np.abs(new - x[todo]).max(axis=1, initial=0) >= 1e-6
        x[todo] = new
        todo = todo[moved]
        if not len(todo):
            break
    total = x.sum(axis=1, keepdims=True)
    return np.where(total > 0, x / np.where(total > 0, total, 1.0), x)


def nnls_many(g: np.ndarray, c: np.ndarray, rounds: int = 500) -> np.ndarray:
    """nnls() of many right sides: ``g`` (cells x types x types) the products of the columns, ``c`` (cells x types) those with the right side."""
    x, todo = np.zeros_like(c), np.arange(len(c))
    for _ in range(rounds):
        own, gt, ct = x[todo], g[todo], c[todo]
        old = own.copy()
        for j in range(c.shape[1]):
            d = gt[:, j, j]
            step = own[:, j] + (ct[:, j] - np.einsum("cj,cj->c", gt[:, j], own)) / np.where(d > 0, d, 1.0)
            own[:, j] = np.where(d > 0, np.maximum(0.0, step), own[:, j])
        x[todo] = own
        todo = todo[np.abs(own - old).max(axis=1, initial=0) >= 1e-10]
        if not len(todo):
            break
    return x


def two_means_cut(position: np.ndarray, weight: np.ndarray) -> float:
    """Middle between the centres of the best split of weighted positions in two (least within squares)."""
    order = np.argsort(position, kind="stable")
    p, w = position[order].astype(float), weight[order].astype(float)
    cw, cs = np.cumsum(w), np.cumsum(w * p)
    if len(p) < 2:
        return float("inf") if not len(p) else float(p[0])
    left, right = cs[:-1] / cw[:-1], (cs[-1] - cs[:-1]) / (cw[-1] - cw[:-1])
    best = int(np.argmax(cw[:-1] * left**2 + (cw[-1] - cw[:-1]) * right**2))
    return float((left[best] + right[best]) / 2)


def rank_cut(position: np.ndarray, weight: np.ndarray, percent: float) -> float:
    """The position above which ``percent`` of the weight lies."""
    order = np.argsort(-position, kind="stable")
    share = np.cumsum(weight[order]) / weight.sum() * 100
    return float(position[order][np.searchsorted(share, percent)])


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative least squares by coordinate descent."""
    g, c, x = a.T @ a, a.T @ b, np.zeros(a.shape[1])
    for _ in range(rounds):
        old = x.copy()
        for j in range(len(x)):
            if g[j, j] > 0:
                x[j] = max(0.0, x[j] + (c[j] - g[j] @ x) / g[j, j])
        if np.abs(x - old).max(initial=0) < 1e-10:
            break
    return x
