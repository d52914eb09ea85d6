"""Random forests over counted cells: rows with the same bins of all features are one cell, and each tree is grown by itself over the cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ShortType, StructField, StructType

from ..shared import stored
from .ranks import exact_bounds

_UNIT = 1 << 40  # probabilities are added up as whole numbers, so that their sum doesn't hang on the order


def grow(bins: np.ndarray, pos: np.ndarray, neg: np.ndarray, depth: int, subset: int, rng: np.random.Generator, together: int = 4096) -> np.ndarray:
    """P(class 1) of every cell by one tree. bins: (cells, features) places; pos, neg: rows of either class by cell, 0 for cells that are only asked for.

    As in Spark's forest: the split with the largest Gini gain among `subset` features drawn for each node, a leaf where nothing is gained, and
    sibling leaves of the same class are taken back into their parent. A level is grown at once, `together` nodes at a time.
    """
    cells, m = bins.shape
    width = int(bins.max(initial=0)) + 1
    p, q = np.array([pos.sum()], float), np.array([neg.sum()], float)  # by node; children have larger numbers
    at, live, levels = np.zeros(cells, np.int64), np.arange(cells), []
    for _ in range(depth):
        live = live[(p[at[live]] > 0) & (q[at[live]] > 0)]
        if not len(live):
            break
        nodes, local = np.unique(at[live], return_inverse=True)
        pick = rng.random((len(nodes), m)).argsort(1)[:, :subset]
        order = np.argsort(local, kind="stable")
        live, local = live[order], local[order]
        gained, feature, cut = np.zeros(len(nodes), bool), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for a in range(0, len(nodes), together):
            b = min(len(nodes), a + together)
            own = slice(*np.searchsorted(local, [a, b]))
            rows, nth = live[own], local[own]
            slot = (((nth - a)[:, None] * subset + np.arange(subset)) * width + bins[rows[:, None], pick[nth]]).ravel()
            left = [np.bincount(slot, np.repeat(x[rows], subset), (b - a) * subset * width).reshape(b - a, -1, width).cumsum(2) for x in (pos, neg)]
            whole = [x[nodes[a:b], None, None] for x in (p, q)]
            right = [w - x for w, x in zip(whole, left, strict=True)]
            n_left, n_right = left[0] + left[1], right[0] + right[1]
            fits = (n_left > 0) & (n_right > 0)
            value = np.where(fits, (left[0] ** 2 + left[1] ** 2) / np.maximum(n_left, 1) + (right[0] ** 2 + right[1] ** 2) / np.maximum(n_right, 1), -1.0).reshape(b - a, -1)
            best = value.argmax(1)
            unsplit = (p[nodes[a:b]] ** 2 + q[nodes[a:b]] ** 2) / (p[nodes[a:b]] + q[nodes[a:b]])
            gained[a:b] = value[np.arange(b - a), best] > unsplit * (1 + 1e-12)
            feature[a:b], cut[a:b] = pick[np.arange(a, b), best // width], best % width
        child = len(p) + 2 * (np.cumsum(gained) - 1)
        go = gained[local]
        live, local = live[go], local[go]
        at[live] = child[local] + (bins[live, feature[local]] > cut[local])
        levels.append((nodes[gained], child[gained]))
        made = 2 * int(gained.sum())
        p, q = (np.append(x, np.bincount(at[live] - len(x), w[live], made)) for x, w in ((p, pos), (q, neg)))
    leaf, first = np.ones(len(p), bool), p > q
    for nodes, child in levels:
        leaf[nodes] = False
    for nodes, child in reversed(levels):
        leaf[nodes] = leaf[child] & leaf[child + 1] & (first[child] == first[child + 1])
    share = p / np.maximum(p + q, 1)
    for nodes, child in levels:
        for side in (child[leaf[nodes]], child[leaf[nodes]] + 1):
            share[side] = share[nodes[leaf[nodes]]]
    return share[at]


def forest_scores(own: DataFrame, features: list[str], label: str, fold: str, folds: int, trees: int, depth: int, seed: int, out: str, most_cells: int = 1 << 18, most_bins: int = 32) -> DataFrame | None:
    """own with the class-1 probability of a random forest trained on the other folds, or None where a fold's rows make more than most_cells cells.

    own is a stored table of finite numbers, its label 0 or 1. Each feature is cut at quantiles of the training rows into most_bins bins, and rows are counted
    by cell. A tree's bootstrap draws a Poisson number for each cell and class with its count as mean: the sum of that many draws of mean 1, as each row's
    own. So after the count no work grows with the rows; cells are at most most_bins to the power of the features. What all tasks get is the counted cells, at most
    `most_cells` a fold; each task grows some of the folds * trees trees.
    """
    spark = own.sparkSession
    long = own.select(F.col(fold).alias("_f"), F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("_i", "_x"))
    counts = long.groupBy("_f", "_i", "_x").agg(F.count(F.lit(1)).alias("_c"))
    left_out = F.explode(F.filter(F.array(*[F.lit(k) for k in range(folds)]), lambda k: k != F.col("_f"))).alias("_k")
    counts = counts.select("*", left_out).select((F.col("_k") * len(features) + F.col("_i")).alias("_key"), "_x", "_c")
    bounds = exact_bounds(counts, "_key", "_x", "_c", most_bins)
    cuts = [[np.array(bounds.get(k * len(features) + i, []), float) for i in range(len(features))] for k in range(folds)]

    names = [f"_b{i}" for i in range(len(features))]

    def placed(batches):
        for batch in batches:
            x = [batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]
            f, y = batch.column(fold), batch.column(label).cast(pa.float64())
            for k in range(folds):
                bins = [pa.array(np.searchsorted(c, v).astype(np.int16)) for c, v in zip(cuts[k], x, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, k, np.int32)), f, y, *bins], names=["_k", "_f", "_y", *names])

    rows = own.select(fold, label, *features).mapInArrow(placed, ", ".join(["_k int, _f int, _y double", *[f"{b} smallint" for b in names]]))
    train = F.col("_f") != F.col("_k")
    cells = rows.groupBy("_k", *names).agg(*[F.count_if(train & ((F.col("_y") == 1) == (side == "_pos"))).alias(side) for side in ("_pos", "_neg")], F.max(~train).alias("_held"))
    cells = stored(cells, "cells")
    most = cells.groupBy("_k").count().agg(F.max("count")).head()[0]
    if most is None or most > most_cells:
        return None if most else own.withColumn(out, F.lit(0.0))
    got = cells.orderBy("_k", *names).toArrow()
    number = got.column("_k").to_numpy()
    table = {}
    for k in range(folds):
        part = got.slice(int(np.searchsorted(number, k)), int((number == k).sum()))
        table[k] = [np.stack([part.column(b).to_numpy() for b in names], 1), *[part.column(c).to_numpy() for c in ("_pos", "_neg", "_held")]]
    shared = spark.sparkContext.broadcast(table)
    subset = len(features) if trees == 1 else math.ceil(math.sqrt(len(features)))

    def grown(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in batch.column("id").to_pylist():
                k, rng = i // trees, np.random.default_rng([seed, i])
                bins, pos, neg, held = shared.value[k]
                pos, neg = rng.poisson(pos), rng.poisson(neg)
                use = np.flatnonzero(held | (pos + neg > 0))
                share = np.zeros(len(bins))
                share[use] = grow(bins[use], pos[use], neg[use], depth, subset, rng)
                sums[k] = sums.get(k, 0) + np.rint(share * _UNIT).astype(np.int64)
        for k, total in sums.items():
            bins, held = shared.value[k][0], shared.value[k][3]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(held.sum(), k, np.int32)), *[pa.array(x) for x in bins[held].T], pa.array(total[held])], names=["_k", *names, "_sum"])

    tasks = min(folds * trees, 4 * spark.sparkContext.defaultParallelism)
    sums = spark.range(0, folds * trees, 1, tasks).mapInArrow(grown, ", ".join(["_k int", *[f"{b} smallint" for b in names], "_sum long"]))
    scores = stored(sums.groupBy("_k", *names).agg((F.sum("_sum") / (trees * float(_UNIT))).alias(out)), "forest")

    def with_bins(batches):
        for batch in batches:
            f = batch.column(fold).to_numpy(zero_copy_only=False)
            bins = np.zeros((len(features), batch.num_rows), np.int16)
            for i, name in enumerate(features):
                x = batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
                for k in range(folds):
                    bins[i, f == k] = np.searchsorted(cuts[k][i], x[f == k])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(b) for b in bins]], names=[*batch.schema.names, *names])

    schema = StructType([*own.schema.fields, *[StructField(b, ShortType()) for b in names]])
    return own.mapInArrow(with_bins, schema).join(scores.withColumnRenamed("_k", fold), [fold, *names]).drop(*names)
