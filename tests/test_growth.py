"""Work that grows no faster than the rows: the same results as by pairs or one by one, and plans without such steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.operators.solve import deconvolve, nnls, nnls_many


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n, m", [(1, 3), (2, 4), (6, 4), (16, 20)])
def test_problems_solved_together_equal_single_ones(n, m):
    r = np.random.default_rng(n)
    a, b = np.where(r.random((80, m, n)) < 0.3, 0, r.normal(size=(80, m, n))), r.normal(size=(80, m))
    a[:20, :, 0] = 2 * a[:20, :, -1]
    got = nnls_many(a, b)
    assert (got >= 0).all() and np.abs(got - [nnls(p, q) for p, q in zip(a, b)]).max() < 1e-6


def test_scans_are_solved_without_a_python_group_each(spark):
    r = np.random.default_rng(4)
    rows = [(s, k, p, float(r.random()), float(10 * s + k)) for s in range(60) for k in range(1 + s % 7) for p in range(1 + s % 20) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "scan_num long, row long, prec_id long, v double, o double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # scans go over batches
    try:
        got = deconvolve(df)
        assert "FlatMapGroupsIn" not in plan(got)
        got = {(x.scan_num, x.prec_id): x.coeff for x in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {(s, p) for s, _, p, _, _ in rows}
    for s in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == s]
        at, cols = sorted({x[1] for x in own}), sorted({x[2] for x in own})
        a, b = np.zeros((len(at), len(cols))), np.zeros(len(at))
        for _, k, p, v, o in own:
            a[at.index(k), cols.index(p)], b[at.index(k)] = v, o
        x = np.array([got[s, p] for p in cols])
        assert np.linalg.norm(a @ x - b) == pytest.approx(np.linalg.norm(a @ nnls(a, b) - b), abs=1e-6)


def test_ranges_are_counted_without_pairs(spark):
    from ionframe.operators import joins

    r = np.random.default_rng(7)
    x, y = r.integers(-40, 40, 500), r.integers(-45, 45, 90)
    pts = spark.createDataFrame([("ab"[i % 2] if i % 9 else None, float(v)) for i, v in enumerate(x)], "k string, x double")
    rng = spark.createDataFrame([("ab"[i % 2], i, float(v), float(v + i % 6 - 1)) for i, v in enumerate(y)], "k string, i int, lo double, hi double")
    for open_lo in (True, False):
        for open_hi in (True, False):
            want = {w.i: w["count"] for w in joins.range_join(pts, "x", rng, "lo", "hi", 5, ["k"], open_lo, open_hi).groupBy("i").count().collect()}
            assert {g.i: g.n for g in joins.range_counts(pts, "x", rng, ["i"], "lo", "hi", ["k"], open_lo, open_hi).collect()} == want


def test_nearest_of_the_holding_ranges_without_pairs(spark):
    from ionframe.operators import joins, probes

    r = np.random.default_rng(8)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.integers(0, 300, 200), r.integers(1, 60, 200)))]
    ranges = [(i, float(a), float(a + w), float(b)) for i, (a, w, b) in enumerate(zip(r.integers(-20, 310, 70), r.integers(-1, 150, 70), r.integers(1, 60, 70)))]
    f = spark.createDataFrame(points, "feature_id int, mz double, rt_apex double")
    s = spark.createDataFrame(ranges, "scan_num int, win_lo double, win_hi double, rt double")
    got = joins.feature_spectrum(f, s)
    hit = {i: min(((abs(t - b), n) for n, lo, hi, t in ranges if lo <= a <= hi), default=None) for i, a, b in points}
    assert {g.feature_id: g.scan_num for g in got.collect()} == {i: h[1] for i, h in hit.items() if h}
    p = f.select(F.col("feature_id").alias("prec_id"), F.col("mz").alias("rt"), F.col("rt_apex").alias("mz"))
    own = s.select(F.col("scan_num").alias("feature_id"), F.col("rt").alias("mz"), F.col("win_lo").alias("rt_start"), F.col("win_hi").alias("rt_end"))
    near = {i: min(((abs(t - b), n) for n, lo, hi, t in ranges if lo <= a <= hi and b * 0.8 <= t <= b * 1.2), default=(0, None))[1] for i, a, b in points}
    assert {g.prec_id: g.feature_id for g in probes.closest_feature(p, own, 0.2).collect()} == near


def test_nearest_match_without_pairs(spark):
    from ionframe.operators import joins

    r = np.random.default_rng(9)
    centres = [(i, "abc"[i % 3], float(v)) for i, v in enumerate(r.integers(1, 200, 90))]
    points = [("ab"[i % 2], float(v)) for i, v in enumerate(r.integers(1, 200, 60))]
    got = joins.nearest_match(spark.createDataFrame(centres, "i int, k string, c double"), ["i"], "c", spark.createDataFrame(points, "k string, x double"), "x", 0.05, ["k"], [])
    assert "_bucket" not in plan(got)
    want = {i: min(((abs(x - c), -x) for m, x in points if m == k and abs(x - c) <= 0.05 * c), default=None) for i, k, c in centres}
    assert {g.i: (g.x, g.rel_error) for g in got.collect()} == {i: (-w[1], (-w[1] - c) / c) for (i, _, c), w in zip(centres, want.values()) if w}


def test_quantiles_are_exact_in_ranges(spark):
    from ionframe.operators.ranks import exact_quantiles

    r = np.random.default_rng(3)
    v = np.round(r.normal(0, 3, 4001), 2)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    shares = [0.0, 0.2, 0.35, 0.5, 0.777, 1.0]
    assert exact_quantiles(df, "v", shares) == pytest.approx(np.quantile(v, shares).tolist(), abs=1e-12)
    assert exact_quantiles(df.where("v is null"), "v", [0.5]) is None


def test_ranks_and_shares_of_a_scan_need_one_sort(spark):
    from ionframe.plans.domain_queries import first_search_acceptance
    from ionframe.plans.queries import topn_norm

    for q in (topn_norm, first_search_acceptance):
        text = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert text.count("Sort [") == text.split("== Initial Plan ==")[0].count("Sort [") == 1


def test_zero_peaks_have_no_anchor_in_sql_either(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from ionframe.plans import queries as q

    spark.createDataFrame([("a", 0.0), ("a", 20.0), ("a", 20.004), ("b", 0.0)], "event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    got = q.QUERIES["merge_anchor"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"select {', '.join(got.columns)} from ({q.SQL['merge_anchor']})").fetchall())


def test_nnls_in_sql_takes_rows_together(spark):
    from ionframe.functions.registered import nnls_rows

    import pyarrow as pa

    r = np.random.default_rng(5)
    a = [None if i == 3 else r.random((i % 5, 2 + i % 3)).tolist() for i in range(40)]
    b = [None if i == 7 else r.random(i % 5 + (i == 9)).tolist() for i in range(40)]
    kind = pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64())
    for cut in (0, 4):
        got = nnls_rows(pa.array(a, kind[0])[cut:], pa.array(b, kind[1])[cut:]).to_pylist()
        for x, p, q in zip(got, a[cut:], b[cut:], strict=True):
            if not p or q is None or len(p) != len(q):
                assert x is None
            else:
                assert x == pytest.approx(nnls(np.array(p), np.array(q)).tolist(), abs=1e-7)
    ragged = nnls_rows(pa.array([[[1.0], [2.0]], [[1.0, 0.0]]], kind[0]), pa.array([[1.0, 2.0], [3.0]], kind[1])).to_pylist()
    assert ragged[0] == pytest.approx([1.0]) and ragged[1] == pytest.approx([3.0, 0.0])
