"""Calibration kernels on small arrays, and their use as column expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from math import comb
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


_POWERS = np.arange(12)
_CHOOSE = np.array([[comb(p, j) for j in _POWERS] for p in _POWERS], float)
_LAG = np.maximum(_POWERS[:, None] - _POWERS, 0)


def _moved(moments: np.ndarray, by: np.ndarray, scale=1.0) -> np.ndarray:
    """Sums of (scale * v + by) ** p, p in 0..11 along the last axis, from the sums of v ** p."""
    by, scale = np.asarray(by, float)[..., None], np.asarray(scale, float)[..., None]
    return ((_CHOOSE * (by**_POWERS)[..., _LAG]) * (moments * scale**_POWERS)[..., None, :]).sum(-1)


def local_sums(xi: np.ndarray, low: np.ndarray, h: np.ndarray, k: int, blocks: tuple, before: np.ndarray, after: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Weighted lines of neighbouring points xi at themselves, over windows of k places from low and of reach h. The blocks (moments, middles, half widths) that lie
    wholly before or after the points in all windows enter by their moments, the other rows (places `at`) one by one. own: y of the points, which
    stay where a window has no weight."""
    moments, mid, half = blocks
    pivot = (xi[0] + xi[-1]) / 2
    sums = np.zeros((5, len(xi)))  # of weights, w d, w d d, w y, w y d, with d in units of the reach
    for side, sign in ((before, 1.0), (after, -1.0)):
        if len(side):
            top = h.max()
            shifted = _moved(moments[:, side], (mid[side] - pivot) / top, half[side] / top).sum(1)
            t = _moved(shifted[:, None], np.broadcast_to((pivot - xi) / top, (2, len(xi)))) * (top / h)[:, None] ** _POWERS
            cube = lambda m, q: m[:, q] + sign * 3 * m[:, q + 3] + 3 * m[:, q + 6] + sign * m[:, q + 9]  # noqa: B023, E731
            sums += [cube(t[0], 0), cube(t[0], 1), cube(t[0], 2), cube(t[1], 0), cube(t[1], 1)]
    for part in np.array_split(np.arange(len(at)), max(1, len(at) * len(xi) // 4_000_000)):
        d = (x[part] - xi[:, None]) / h[:, None]
        u = np.abs(d)
        v = np.clip(1 - u * u * u, 0, None)
        v = np.where((at[part] >= low[:, None]) & (at[part] < low[:, None] + k), v * v * v, 0) * w[part]
        vd = v * d
        sums += [v.sum(1), vd.sum(1), (vd * d).sum(1), v @ y[part], vd @ y[part]]
    s0, s1, s2, sy, s1y = sums
    some = s0 > 1e-12
    s0 = np.where(some, s0, 1)
    spread = s2 - s1 * s1 / s0
    steep = spread > 1e-12
    slope = np.where(steep, (s1y - s1 * sy / s0) / np.where(steep, spread, 1), 0)
    return np.where(some, (sy - slope * s1) / s0, own)


def _local_lines(x: np.ndarray, y: np.ndarray, weight: np.ndarray, lo: np.ndarray, k: int) -> np.ndarray:
    """The weighted line of every window [lo, lo + k) at its own x. The tricube weight is a polynomial on each side of a point, so blocks
    that lie wholly on one side in all windows of a block of points enter by their moments; the rest is summed row by row."""
    n = len(x)
    size = max(32, int(n**0.5))
    starts = np.arange(0, n, size)
    ends = np.minimum(starts + size, n)
    mid, half = (x[starts] + x[ends - 1]) / 2, (x[ends - 1] - x[starts]) / 2
    own = np.arange(n) // size
    v = np.clip((x - mid[own]) / np.where(half > 0, half, 1)[own], -1, 1)
    powers = weight[:, None] * v[:, None] ** _POWERS
    moments = np.stack([np.add.reduceat(powers, starts), np.add.reduceat(powers * y[:, None], starts)])
    reach = np.maximum(np.maximum(x - x[lo], x[lo + k - 1] - x), 1e-300)
    fit = np.empty(n)
    for b, (first, last) in enumerate(zip(starts, ends, strict=True)):
        low, h = lo[first:last], 1.0001 * reach[first:last]
        inside = np.flatnonzero((starts >= low[-1]) & (ends <= low[0] + k))
        # Moments lose no digits only where the windows of the block are alike and much wider than it.
        inside = inside[inside != b] if h.max() <= 1.5 * h.min() and half[b] <= h.min() / 8 else inside[:0]
        whole = np.zeros(n, bool)
        for c in inside:
            whole[starts[c] : ends[c]] = True
        at = np.arange(low[0], low[-1] + k)
        at = at[~whole[at]]
        fit[first:last] = local_sums(x[first:last], low, h, k, (moments, mid, half), inside[inside < b], inside[inside > b], at, x[at], y[at], weight[at], y[first:last])
    return fit


def lowess(x, y, frac: float = 0.2, robust: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Locally weighted lines (tricube weights over the nearest share, then bisquare on residuals) over all points;
    sorted distinct x and fitted values."""
    order = np.argsort(np.asarray(x, float), kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = len(x)
    if n < 3:
        return x, y
    k = min(n, max(2, int(np.ceil(frac * n))))
    lows, lo, at = np.empty(n, int), 0, x.tolist()
    for i in range(n):
        while lo + k < n and at[i] - at[lo] > at[lo + k] - at[i]:
            lo += 1
        lows[i] = lo
    weight = np.ones(n)
    for _ in range(robust + 1):
        fit = _local_lines(x, y, weight, lows, k)
        r = np.abs(y - fit)
        if r.max() <= 1e-12 * max(1.0, np.abs(y).max()):
            break
        s = max(np.median(r), 1e-6 * r.max())
        weight = np.clip(1 - (r / (6 * s)) ** 2, 0, None) ** 2
    xs, first = np.unique(x, return_index=True)
    return xs, fit[first]


def interpolation(x: Column, knots: np.ndarray, values: np.ndarray) -> Column:
    """Linear interpolation in a small knot table, clamped at its ends, by binary search in the engine."""
    if len(knots) == 1:
        return F.lit(float(values[0]))
    ks, vs = F.array(*[F.lit(float(k)) for k in knots]), F.array(*[F.lit(float(v)) for v in values])
    inner = F.greatest(F.lit(float(knots[0])), F.least(F.lit(float(knots[-1])), x))
    i = F.greatest(F.lit(1), F.least(F.lit(len(knots) - 1), F.size(F.filter(ks, lambda k: k <= inner))))
    x0, x1, y0, y1 = F.get(ks, i - 1), F.get(ks, i), F.get(vs, i - 1), F.get(vs, i)
    return y0 + (y1 - y0) * (inner - x0) / (x1 - x0)


def even_grid(knots: np.ndarray, values: np.ndarray, n: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """A curve on n evenly spaced knots, which a column expression finds without a search."""
    at = np.linspace(knots[0], knots[-1], n if len(knots) > 1 and knots[-1] > knots[0] else 1)
    return at, np.interp(at, knots, values)


def on_grid(x: Column, knots: np.ndarray, values: np.ndarray) -> Column:
    """Linear interpolation on an even grid, clamped at its ends."""
    if len(knots) == 1:
        return F.lit(float(values[0]))
    vs, step = F.array(*[F.lit(float(v)) for v in values]), float(knots[1] - knots[0])
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(len(knots) - 1)), (x - F.lit(float(knots[0]))) / step))
    i = F.least(F.floor(at), F.lit(len(knots) - 2)).cast("int")
    return F.get(vs, i) + (F.get(vs, i + 1) - F.get(vs, i)) * (at - i)


def thin(knots: np.ndarray, values: np.ndarray, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """A curve at most so many knots, evenly by rank, with its ends."""
    pick = np.unique(np.linspace(0, len(knots) - 1, min(most, len(knots))).round().astype(int))
    return knots[pick], values[pick]


def gaussian_sigma(errors, bins: int = 50, steps: int = 100) -> tuple[float, float]:
    """(mean, sigma) of a Gaussian fitted to a histogram of errors."""
    errors = np.asarray(errors, float)
    counts, edges = np.histogram(errors, bins)
    return gaussian_of_counts(counts, edges, errors.std(), steps)


def gaussian_of_counts(counts, edges, spread: float, steps: int = 100) -> tuple[float, float]:
    """(mean, sigma) of a Gaussian fitted to a histogram by damped Gauss-Newton from its tallest bin; spread: the values' standard deviation."""
    counts, edges = np.asarray(counts, float), np.asarray(edges, float)
    x = (edges[:-1] + edges[1:]) / 2
    p = np.array([counts.max(), x[counts.argmax()], max(spread, 1e-12)])
    damp, f = 1e-3, lambda q: q[0] * np.exp(-((x - q[1]) ** 2) / (2 * q[2] ** 2))
    for _ in range(steps):
        g = f(p)
        j = np.stack([g / p[0], g * (x - p[1]) / p[2] ** 2, g * (x - p[1]) ** 2 / p[2] ** 3], 1)
        h = j.T @ j
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-30), j.T @ (counts - g), rcond=None)[0]
        if (q := p + step)[2] > 0 and q[0] > 0 and ((counts - f(q)) ** 2).sum() < ((counts - g) ** 2).sum():
            done = np.abs(step / np.maximum(np.abs(p), 1e-12)).max() < 1e-10
            p, damp = q, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return float(p[1]), float(abs(p[2]))


def boundary(mad: float, p: float, kind: str) -> float:
    """Quantile p of absolute errors of that median deviation, exponential or half-normal."""
    if kind == "exponential":
        return -(mad / np.log(2)) * np.log(1 - p)
    return 1.4826 * mad * NormalDist().inv_cdf((1 + p) / 2)


def error_boundary(errors, p: float = 0.99) -> tuple[float, str]:
    """The tolerance that holds a share p of absolute errors under the better of the two models."""
    a = np.sort(np.abs(np.asarray(errors, float)))
    mad = float(np.median(a))
    if mad == 0:
        return 0.0, "exponential"
    at = np.arange(1, len(a) + 1) / len(a)
    normal = NormalDist(0, 1.4826 * mad)
    half = np.array([2 * normal.cdf(v) - 1 for v in a])
    kind = "half-normal" if ((half - at) ** 2).sum() < ((1 - np.exp(-a * np.log(2) / mad) - at) ** 2).sum() else "exponential"
    return float(boundary(mad, p, kind)), kind


def better_by_cdf(first, second) -> int:
    """0 or 1: which error list has the larger area under the CDF of its absolute errors over their common range."""
    top = max(np.abs(first).max(), np.abs(second).max())
    grid = np.linspace(0, top, 512)
    area = [np.trapezoid(np.searchsorted(np.sort(np.abs(e)), grid, side="right") / len(e), grid) for e in (first, second)]
    return int(area[1] > area[0])


def step_spline(x, y, steps: int = 2, knots: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of a continuous piecewise line fitted by least squares again and again: each step leaves out the points whose
    residual is beyond two robust deviations of the last fit. Knots lie at even ranks of x. Below four points the points themselves."""
    order = np.argsort(np.asarray(x, float), kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    if len(np.unique(x)) < 4:
        xs, first = np.unique(x, return_index=True)
        return xs, np.array([y[x == v].mean() for v in xs])
    at = np.unique(np.quantile(x, np.linspace(0, 1, max(2, min(knots, len(np.unique(x)) // 2)))))
    hats = np.stack([np.interp(x, at, row) for row in np.eye(len(at))], 1)
    keep = np.ones(len(x), bool)
    for step in range(steps):
        values = np.linalg.lstsq(np.vstack([hats[keep], 1e-9 * np.eye(len(at))]), np.append(y[keep], np.zeros(len(at))), rcond=None)[0]
        rest = np.abs(y - hats @ values)
        if step + 1 < steps:
            keep = rest <= max(2 * 1.4826 * np.median(rest[keep]), 1e-12)
    return at, values


Curve = tuple[tuple[float, ...], tuple[float, ...]]


@dataclass(frozen=True)
class Calibration:
    """Curves as knot tables, and tolerances; plain values, so they can be stored as JSON.

    rt: run time on library time. mz_by_rt and mz_by_mz: relative errors of survey peaks on run time and, of what is left, on m/z;
    frag_by_rt and frag_by_mz: those of fragment peaks. rt_tol, ms1_tol and mz_tol are what residuals ask for.
    """

    rt: Curve
    mz_by_rt: Curve
    mz_by_mz: Curve
    frag_by_rt: Curve
    frag_by_mz: Curve
    rt_tol: float
    ms1_tol: float
    mz_tol: float

    def as_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of_json(cls, text: str) -> Calibration:
        got = json.loads(text)
        return cls(**{k: tuple(map(tuple, v)) if isinstance(v, list) else v for k, v in got.items()})

    def predicted_rt(self, irt: Column) -> Column:
        return interpolation(irt, *map(np.array, self.rt))

    def _error(self, mz: Column, rt: Column, level: int) -> Column:
        by_rt, by_mz = (self.mz_by_rt, self.mz_by_mz) if level == 1 else (self.frag_by_rt, self.frag_by_mz)
        return on_grid(rt, *even_grid(*map(np.array, by_rt))) + on_grid(mz, *even_grid(*map(np.array, by_mz)))

    def corrected_mz(self, mz: Column, rt: Column, level: int = 1) -> Column:
        """Where the instrument shows a true m/z at a time: in survey scans (level 1) or among fragments (2)."""
        return mz + mz * self._error(mz, rt, level)

    def corrected_peaks(self, mz: Column, rt: Column, level: Column) -> Column:
        """An array of observed m/z without the instrument's error, by the scan's level; the order stays."""
        move = lambda n: F.transform(mz, lambda m: m / (1 + self._error(m, rt, n)))
        return F.when(level == 1, move(1)).otherwise(move(2))
