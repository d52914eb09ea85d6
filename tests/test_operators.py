import random

import pytest
from pyspark.sql import functions as F

from ionframe.operators import features, joins, scoring, spectra, traces


def test_merge_and_bins_golden(spark):
    rows = [(1, mz, i) for mz, i in ((100.0, 1.0), (100.0008, 2.0), (100.0016, 4.0), (100.01, 8.0))]
    df = spark.createDataFrame(rows, "scan int, mz double, i double")
    merged = sorted((r["anchor"], r["i"]) for r in spectra.merge_peaks(df, "mz", "i", 1e-5, ["scan"]).collect())
    assert merged == [(100.0, 3.0), (100.0008, 4.0), (100.01, 8.0)]
    bins = sorted((r["lo"], r["hi"]) for r in spectra.tolerance_bins(spark.createDataFrame([(1, m) for m, _ in merged], "scan int, mz double"), "mz", 1e-5, ["scan"]).collect())
    assert bins[0] == pytest.approx((99.999, 99.999799992)) and bins[1] == pytest.approx((100.001, 100.001800008))


def test_joins_against_brute_force(spark):
    r = random.Random(5)
    pts = [(i, r.choice("ab"), float(r.randint(1, 400))) for i in range(200)]
    cen = [(i, r.choice("ab"), float(r.randint(1, 400))) for i in range(50)]
    a, c = spark.createDataFrame(pts, "p int, k string, x double"), spark.createDataFrame(cen, "c int, k string, y double")
    got = {(x["p"], x["c"]) for x in joins.tolerance_join(a, "x", c, "y", 0.05, ["k"]).collect()}
    assert got == {(p, q) for p, k, x in pts for q, m, y in cen if k == m and y * 0.95 < x <= y * 1.05}
    rng = c.withColumns({"lo": F.col("y") - 7, "hi": F.col("y") + 7})
    got = [(x["p"], x["c"]) for x in joins.range_join(a, "x", rng, "lo", "hi", 10, ["k"]).collect()]
    want = {(p, q) for p, k, x in pts for q, m, y in cen if k == m and y - 7 < x <= y + 7}
    assert set(got) == want and len(got) == len(want)
    near = {x["p"]: x["near"] for x in joins.nearest(a, c.withColumnRenamed("y", "x").select("k", "x"), "x", ["k"]).collect()}
    for p, k, x in pts:
        best = min((abs(y - x), -(y >= x), y) for _, m, y in cen if m == k)
        assert near[p] == best[2]


def test_qvalues_golden(spark):
    df = spark.createDataFrame([(i, 10 - i, d) for i, d in enumerate([0, 0, 1, 0, 1])], "id int, score int, decoy int")
    got = {r["id"]: r["qvalue"] for r in scoring.qvalues(df, F.col("decoy") == 1, "score", ["id"]).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0, 0, 1 / 3, 1 / 4, 2 / 5])


def test_scores_golden(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    p, o = arr(50, 30, 20), arr(50, 20, 40)
    row = spark.range(1).select(
        features.scribe(arr(0.5, 0.3, 0.2), o), features.manhattan(p, o), features.contrast(p, o), features.cosine(p, o),
        features.gof(F.zip_with(o, p, lambda a, b: a - b), p), features.largest_residual(F.zip_with(o, p, lambda a, b: a - b), o, p),
        features.hyperscore(F.lit(0.8), F.lit(2), F.lit(1)), features.hyperscore(F.lit(12.0), F.lit(3), F.lit(2)),
    ).head()
    assert list(row) == pytest.approx([0.0138220608, 1.8744691179, 0.0151019924, 0.9431191251, -1.7369655942, -2.3219280942, 0.4700036292, 4.9698132996], abs=1e-6)


def test_areas_golden(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 5, 9, 4, 2])], "k int, x int, y double")
    assert traces.apex_area(df, ["k"], "x", "y").head()["apex"] == 18
    iso = spark.createDataFrame([(1, t, float(o)) for t, o in zip([0.5, 0.3, 0.15, 0.05], [100, 58, 33, 9])], "k int, t double, o double")
    r = traces.isotope_fit(iso, ["k"], "t", "o").head()
    assert (r["slope"], r["r"]) == pytest.approx((199.4520547945, 0.9984933319))


def test_intervals_merge(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 5.0, 6.0)], "k int, lo double, hi double")
    assert sorted((r["lo"], r["hi"], r["n"]) for r in joins.merge_intervals(df, "lo", "hi", ["k"]).collect()) == [(0, 3, 2), (5, 6, 1)]
