"""Forests over counted cells: trees by recursion, scores that don't hang on partitions, and work that doesn't grow with the rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from ionframe.operators import scoring
from ionframe.operators.forest import forest_scores, grow
from ionframe.operators.ranks import exact_bounds


def plain_tree(bins, pos, neg, depth):
    """P(class 1) of each cell: the best Gini split over all features, recursively; sibling leaves of one class become their parent."""
    share = np.zeros(len(bins))

    def walk(cells, left):
        p, n = pos[cells].sum(), neg[cells].sum()
        best = None
        for f in range(bins.shape[1]):
            for c in range(bins.max()):
                low = bins[cells, f] <= c
                a, b = cells[low], cells[~low]
                sums = [(pos[x].sum(), neg[x].sum()) for x in (a, b)]
                if left and p and n and all(sum(x) for x in sums):
                    gain = sum((u * u + v * v) / (u + v) for u, v in sums) - (p * p + n * n) / (p + n)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = gain, a, b
        share[cells] = p / max(1, p + n)
        if best is None:
            return p > n
        mine = share[cells].copy()
        kinds = [walk(x, left - 1) for x in best[1:]]
        if kinds[0] is not None and (kinds[0] == kinds[1]):
            share[cells] = mine
            return p > n
        return None

    walk(np.arange(len(bins)), depth)
    return share


def test_a_tree_equals_one_by_recursion():
    r = np.random.default_rng(5)
    for depth in (1, 2, 4, 20):
        for together in (1, 4096):
            bins = np.unique(r.integers(0, 5, (60, 3)), axis=0).astype(np.int16)
            pos, neg = r.integers(0, 900, len(bins)) * (r.random(len(bins)) < 0.8), r.integers(0, 900, len(bins)) * (r.random(len(bins)) < 0.7)
            assert np.allclose(grow(bins, pos, neg, depth, 3, np.random.default_rng(1), together), plain_tree(bins, pos, neg, depth))


def table(spark, n, parts):
    r = random.Random(n)
    rows = []
    for i in range(n):
        x, y = r.randrange(40), r.random()
        rows.append((i, f"g{i % 30}", x, None if i % 17 == 0 else y, int((x > 20) != (r.random() < 0.1))))
    return spark.createDataFrame(rows, "id long, g string, x int, y double, label int").repartition(parts)


def test_scores_by_folds_do_not_hang_on_partitions(spark):
    got = [{r["id"]: r["score"] for r in scoring.cross_validated(table(spark, 600, parts), ["x", "y"], "label", "g", trees=20).collect()} for parts in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 600 and all(0 <= s <= 1 for s in got[0].values())
    label = {r["id"]: r["label"] for r in table(spark, 600, 1).collect()}
    assert np.mean([(s >= 0.5) == label[i] for i, s in got[0].items()]) > 0.8


def test_a_forest_needs_no_pass_over_the_rows_for_each_level(spark):
    sc = spark.sparkContext
    sc.setJobGroup("forest", "forest")
    try:
        assert scoring.cross_validated(table(spark, 400, 2), ["x", "y"], "label", "g", trees=10).count() == 400
        assert len(sc.statusTracker().getJobIdsForGroup("forest")) < 60
    finally:
        sc._jsc.clearJobGroup()


def test_copies_of_rows_add_no_cells_and_more_cells_than_allowed_are_left_to_spark(spark):
    own = table(spark, 300, 2).fillna(0.0).select("*", F.col("label").alias("_y"), scoring.group_folds(F.col("g")).alias("_fold"))
    args = (["x", "y"], "_y", "_fold", 5, 5, 20, 42, "score")
    assert forest_scores(own, *args, most_cells=20) is None
    many = forest_scores(own.unionAll(own).unionAll(own), *args, most_cells=300)
    assert many is not None and many.count() == 900


def test_bounds_of_many_keys_at_once(spark):
    r = random.Random(2)
    rows = [(k, float(r.randrange(50)), r.randrange(1, 4)) for k in range(4) for _ in range(3 if k == 2 else 200)]
    got = exact_bounds(spark.createDataFrame(rows, "k int, x double, n long"), "k", "x", "n", 8)
    for k in range(4):
        own = sorted(x for j, x, n in rows if j == k for _ in range(n))
        assert got[k] == sorted({own[-(-len(own) * i // 8) - 1] for i in range(1, 8)})
    assert exact_bounds(spark.createDataFrame([], "k int, x double, n long"), "k", "x", "n", 8) == {}
