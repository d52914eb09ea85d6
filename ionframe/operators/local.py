"""Local regression over any number of rows: range parts with halos, and moments of blocks in between."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .calibrate import gaussian_of_counts, interpolation, local_sums, lowess
from .ranks import exact_medians, running

PER_PART = 32  # blocks of a part
MOST = 256  # rows of a block, however many rows there are
GROUP = 64  # blocks whose moments are also held as one
POWERS = 12


def _part_fit(rows: pd.DataFrame, blocks: pd.DataFrame, part: int, n: int, size: int, k: int) -> pd.DataFrame:
    """The part's own rows with their fits. rows: those of the blocks that hold the part or the ends of its windows; blocks: moments of the
    blocks, or runs of `span` blocks, that its windows touch."""
    rows, blocks = rows.sort_values("pos"), blocks.sort_values("block")
    pos, x, y, w = (rows[c].to_numpy() for c in ("pos", "x", "y", "w"))
    block = pos // size
    starts = blocks["block"].to_numpy() * size
    ends = np.minimum(starts + blocks["span"].to_numpy() * size, n)
    mid, half = blocks["mid"].to_numpy(), blocks["half"].to_numpy()
    moments = np.stack([np.stack([blocks[f"{c}{p}"].to_numpy() for p in range(POWERS)], 1) for c in ("a", "b")])

    # A window starts at the first place from which its two ends are no longer nearer on the left than on the right.
    partner = np.searchsorted(pos, pos + k)
    last = pos == n - k
    paired = (partner < len(pos)) & (pos[np.minimum(partner, len(pos) - 1)] == pos + k)
    use = last | paired
    ends_sum = np.where(last, np.inf, x + x[np.minimum(partner, len(pos) - 1)])[use]
    own = np.flatnonzero(block // PER_PART == part)
    lo = pos[use][np.searchsorted(ends_sum, 2 * x[own])]
    reach = np.maximum(np.maximum(x[own] - x[np.searchsorted(pos, lo)], x[np.searchsorted(pos, lo + k - 1)] - x[own]), 1e-300)

    fit = np.empty(len(own))
    todo = [(i, j) for i, j in zip(*(lambda edge: (edge[:-1], edge[1:]))(np.append(np.flatnonzero(np.append(True, np.diff(block[own]) > 0)), len(own))), strict=True)]
    while todo:
        i, j = todo.pop()
        xi, low, h = x[own[i:j]], lo[i:j], 1.0001 * reach[i:j]
        if j - i > 1 and (h.max() > 1.5 * h.min() or xi[-1] - xi[0] > h.min() / 4):  # too unlike for one pivot
            todo += [(i, (i + j) // 2), ((i + j) // 2, j)]
            continue
        inside = np.flatnonzero((starts >= low[-1]) & (ends <= low[0] + k) & (starts // size != block[own[i]]))
        span = np.flatnonzero((pos >= low[0]) & (pos < low[-1] + k) & ~np.isin(block, starts[inside] // size))
        if len(span) + int((ends[inside] - starts[inside]).sum()) != low[-1] + k - low[0]:
            raise ValueError("a halo is too short")
        before = starts[inside] < pos[own[i]]
        fit[i:j] = local_sums(xi, low, h, k, (moments, mid, half), inside[before], inside[~before], pos[span], x[span], y[span], w[span], y[own[i:j]])
    return rows.iloc[own].assign(fit=fit)


def _cover(low: int, high: int, group: int):
    """(block, span): the blocks low..high - 1, whole groups as one."""
    while low < high:
        span = group if low % group == 0 and low + group <= high else 1
        yield low, span
        low += span


def _windows(blocks: pd.DataFrame, k: int, n: int, size: int, group: int) -> pd.DataFrame:
    """(part, block, span, raw): the blocks, or whole groups of them, that each part's windows touch, and the blocks of which it needs the rows; from the blocks' ends alone."""
    blocks = blocks.sort_values("block")
    first, last, count = blocks["first_x"].to_numpy(), blocks["last_x"].to_numpy(), len(blocks)
    at = np.arange(count) * size
    inner = at + k < n  # window starts that aren't the last one
    beyond = np.minimum((at + k) // size, count - 1)
    most, least = np.where(inner, first + last[beyond], np.inf), np.where(inner, first + first[beyond], np.inf)
    out = []
    for part in range(0, (count - 1) // PER_PART + 1):
        b0, b1 = part * PER_PART, min(count, (part + 1) * PER_PART) - 1
        left = max(0, int(np.searchsorted(most, 2 * first[b0])) - 1)
        right = min(count - 1, int(np.searchsorted(least, 2 * last[b1])))
        lo, hi = left * size, min(right * size, n - k)
        raw = {*range(left, max(right, hi // size) + 1), *range(max(0, lo + k - 1) // size, min(n - 1, hi + k) // size + 1), *range(b0, b1 + 1)}
        own = sorted(raw)
        out += [(part, b, 1, True) for b in own]
        out += [(part, b, span, False) for last_raw, next_raw in zip(own, own[1:]) for b, span in _cover(last_raw + 1, next_raw, group)]
    return pd.DataFrame(out, columns=["part", "block", "span", "raw"])


def local_regression(df: DataFrame, x: str, y: str, frac: float = 0.2, robust: int = 3, on: list[str] | None = None, small: int = 20_000, blocks: int = 1024, group: int = GROUP) -> DataFrame:
    """(on, pos, n, x, y, fit): locally weighted lines, as calibrate.lowess fits them, over all rows of each key.

    Keys of up to `small` rows are fitted in one task each. Larger ones are cut into `blocks` blocks of neighbouring ranks, or more of MOST rows each, so that what is summed row by row doesn't grow with a key; a task gets the rows of a few blocks and of those
    where its windows end, and of the blocks in between their moments, of whole groups of `group` blocks at once: the weight is a polynomial on either side of a point. So each round
    shuffles a key's rows about four times and holds no more than some blocks in a task. Rows with a null x or y take no part. pos numbers a key's rows by
    x and then y, from 0.
    """
    names, keys = on or [], [f"_g{i}" for i in range(len(on or []))]
    if {"pos", "n", "x", "y", "fit"} & set(names):
        raise ValueError("a key can't have the name of a result column")
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, keys, strict=True)], F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    keyed = stored(own.withColumn("_all", F.lit(0)), "points")
    on = [*keys, "_all"]
    counts = stored(keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), "counts")
    types = ", ".join(f"`{c}` {dict(keyed.dtypes)[c]}" for c in on)
    out_schema = f"{types}, pos long, n long, x double, y double, fit double"

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["x", "y"], kind="stable")
        xs, fit = lowess(part["x"], part["y"], frac, robust)
        fit = fit if len(fit) == len(part) else fit[np.searchsorted(xs, part["x"])]
        return part.assign(pos=np.arange(len(part)), fit=fit)[[*on, "pos", "n", "x", "y", "fit"]]

    rows = keyed.join(counts, on)
    lesser = rows.where(F.col("n") <= small).groupBy(*on).applyInPandas(whole, out_schema)
    named = lambda d: d.select(*[F.col(k).alias(c) for c, k in zip(names, keys, strict=True)], "pos", "n", "x", "y", "fit")
    if counts.where(F.col("n") > small).isEmpty():
        return named(lesser)

    ranked = running(rows.where(F.col("n") > small), F.lit(1), [(c, False) for c in [*on, "x", "y"]], "_one").drop("_one")
    heads = counts.where(F.col("n") > small).select(*on, (F.sum("n").over(Window.orderBy(*on)) - F.col("n")).alias("_before"))  # one row per large key
    size = F.greatest(F.lit(64), F.least(F.lit(MOST), F.ceil(F.col("n") / blocks))).cast("long")
    state = ranked.join(heads, on).withColumns({"pos": F.col("rank") - 1 - F.col("_before"), "size": size, "w": F.lit(1.0)}).drop("rank", "_before")
    state = stored(state.withColumn("block", F.floor(F.col("pos") / F.col("size"))), "ranked")
    window = F.least("n", F.greatest(F.lit(2), F.ceil(F.lit(frac) * F.col("n")))).cast("long")
    ends = stored(state.groupBy(*on, "block").agg(F.min("x").alias("first_x"), F.max("x").alias("last_x"), F.first("n").alias("n"), F.first("size").alias("size")).withColumn("k", window), "blocks")
    wide = ends.groupBy(*on, (F.floor(F.col("block") / group) * group).alias("block")).agg(F.min("first_x").alias("first_x"), F.max("last_x").alias("last_x"))
    runs = {span: d.select(*on, "block", F.lit(span).cast("long").alias("span"), ((F.col("first_x") + F.col("last_x")) / 2).alias("mid"), ((F.col("last_x") - F.col("first_x")) / 2).alias("half")) for span, d in ((1, ends), (group, wide))}

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        head = part.iloc[0]
        return _windows(part, int(head["k"]), int(head["n"]), int(head["size"]), group).assign(**{c: head[c] for c in on}, k=int(head["k"]))

    plans = stored(ends.groupBy(*on).applyInPandas(plan, f"{types}, part long, block long, span long, raw boolean, k long"), "windows")

    def fit(rows: pd.DataFrame, moments: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        fitted = _part_fit(rows, moments, int(head["part"]), int(head["n"]), int(head["size"]), int(head["k"]))
        return fitted[[*on, "pos", "n", "x", "y", "fit", "w", "size", "block"]]

    fitted_schema = f"{types}, pos long, n long, x double, y double, fit double, w double, size long, block long"
    for turn in range(robust + 1):
        v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("x") - F.col("mid")) / F.when(F.col("half") > 0, F.col("half")).otherwise(1.0)))
        power = lambda p: F.col("w") if p == 0 else F.col("w") * F.pow("_v", F.lit(float(p)))
        sums = [*[F.sum(power(p)).alias(f"a{p}") for p in range(POWERS)], *[F.sum(power(p) * F.col("y")).alias(f"b{p}") for p in range(POWERS)]]
        moments = None
        for span, run in runs.items():
            placed = state.withColumn("block", F.floor(F.col("block") / span) * span).join(run, [*on, "block"]).withColumn("_v", v)
            own = placed.groupBy(*on, "block", "span", "mid", "half").agg(*sums)
            moments = own if moments is None else moments.unionByName(own)
        left = state.toDF(*state.columns).join(plans.toDF(*plans.columns).where("raw"), [*on, "block"]).groupBy(*on, "part")  # toDF: columns apart from those of moments
        state = stored(left.cogroup(moments.join(plans, [*on, "block", "span"]).groupBy(*on, "part")).applyInPandas(fit, fitted_schema), "fitted")
        if turn < robust:
            r = F.abs(F.col("y") - F.col("fit"))
            spread = exact_medians(state.select(*on, r.alias("_r")), on, "_r", "_m").join(state.groupBy(*on).agg(F.max(r).alias("_top")), on)
            s = F.greatest(F.col("_m"), 1e-6 * F.col("_top"))
            u = F.least(F.lit(1.0), r / (6 * F.when(s > 0, s)))
            state = state.drop("w").join(spread, on).withColumn("w", F.when(s > 0, F.pow(1 - u * u, F.lit(2.0))).otherwise(1.0)).drop("_m", "_top", "fit")
            state = stored(state, "weighed")
    return named(lesser.unionByName(state.select(*on, "pos", "n", "x", "y", "fit")))


def curve(fitted: DataFrame, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of one key's fit at up to about `most` even ranks and both ends."""
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    got = fitted.where((F.col("pos") % step == 0) | (F.col("pos") == F.col("n") - 1)).groupBy("x").agg(F.min("fit").alias("fit")).orderBy("x").toPandas()  # at most `most` + 2 rows
    return got["x"].to_numpy(), got["fit"].to_numpy()


def residual(x: str, y: str, knots: tuple[np.ndarray, np.ndarray]):
    """y less a curve at x."""
    return F.col(y) - interpolation(F.col(x), *knots)


def gaussian_width(df: DataFrame, value: str, bins: int = 50) -> float:
    """Sigma of a Gaussian fitted to the histogram of a column (even steps from its least to its largest value: `bins`, or fewer where rows are few), but no less
    than the median distance from 0 asks for; 0 where all are alike."""
    span = df.agg(F.min(value), F.max(value), F.stddev_pop(value), F.count(value), F.percentile_approx(F.abs(value), 0.5, 10_000)).head()
    if span[0] is None or span[0] == span[1]:
        return 0.0
    bins = max(5, min(bins, int(span[3] ** 0.5)))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - span[0]) / (span[1] - span[0]) * bins))
    counts = np.zeros(bins)
    for row in df.where(F.col(value).isNotNull()).groupBy(at.alias("k")).count().collect():  # at most `bins` rows
        counts[int(row["k"])] = row["count"]
    return max(gaussian_of_counts(counts, np.linspace(span[0], span[1], bins + 1), span[2])[1], 1.4826 * span[4])
