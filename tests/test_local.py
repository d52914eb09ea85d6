"""Local regression by parts against the whole, exact medians, and registered functions on odd input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionframe.functions import peptide
from ionframe.functions.registered import register
from ionframe.operators import calibrate, local, ranks


def test_parts_equal_the_whole(spark):
    r = np.random.default_rng(1)
    n = 6000
    x = np.concatenate([r.random(n // 2) * 3, r.normal(1.5, 0.02, n // 4), r.integers(0, 30, n // 4) / 10])  # dense places, gaps and ties
    y = np.sin(3 * x) + r.standard_cauchy(n) * 0.2
    k = np.where(np.arange(n) % 5 == 0, "b", "a")
    df = spark.createDataFrame(pd.DataFrame({"k": k, "u": x, "v": y})).unionAll(spark.createDataFrame([("a", None, 1.0), ("b", 1.0, None), ("c", 1.0, 2.0)], "k string, u double, v double"))
    got = local.local_regression(df, "u", "v", 0.2, on=["k"], small=2000, blocks=40).toPandas()
    assert set(got.k) == {"a", "b", "c"} and len(got) == n + 1
    for key in "ab":
        xs, fit = calibrate.lowess(x[k == key], y[k == key], 0.2)
        own = got[got.k == key].sort_values("pos")
        assert own.pos.tolist() == list(range((k == key).sum())) and np.abs(own.fit - fit[np.searchsorted(xs, own.x)]).max() < 1e-9
    knots, values = local.curve(spark.createDataFrame(got[got.k == "a"]), 50)
    assert len(knots) <= 52 and knots[0] == x[k == "a"].min() and knots[-1] == x[k == "a"].max()
    assert local.local_regression(df.where("false"), "u", "v").count() == 0


def test_groups_of_blocks_equal_the_whole(spark):
    r = np.random.default_rng(5)
    n = 9000
    x = np.concatenate([r.random(n // 2) * 3, r.normal(1.5, 0.02, n // 4), r.integers(0, 30, n // 4) / 10])
    y = np.sin(3 * x) + r.standard_cauchy(n) * 0.2
    xs, fit = calibrate.lowess(x, y, 0.6)
    got = local.local_regression(spark.createDataFrame(pd.DataFrame({"u": x, "v": y})), "u", "v", 0.6, small=2000, blocks=140, group=4).toPandas().sort_values("pos")
    assert got.pos.tolist() == list(range(n)) and np.abs(got.fit - fit[np.searchsorted(xs, got.x)]).max() < 1e-9


@pytest.mark.parametrize("n", [400_000, 3_200_000])
def test_rows_and_moments_of_a_part_do_not_grow_with_the_key(n):
    size = min(local.MOST, n // 1024)
    at = np.arange(0, n, size)
    plan = local._windows(pd.DataFrame({"block": np.arange(len(at)), "first_x": at / n, "last_x": np.minimum(at + size, n) / n}), int(0.3 * n), n, size, local.GROUP)
    own = plan.groupby("part")
    assert own["raw"].sum().max() * size < 40_000 and own.size().max() < 400
    assert all(sorted(b for f, s in zip(d.block, d.span) for b in range(f, f + s)) == list(range(d.block.min(), d.block.max() + 1)) for _, d in own)


def test_medians_are_exact(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": r.integers(0, 3, 5001), "v": np.where(r.random(5001) < 0.4, 7.0, r.standard_cauchy(5001))})
    got = ranks.exact_medians(spark.createDataFrame(pdf).unionAll(spark.createDataFrame([(9, None), (8, 2.0), (8, 5.0)], "k long, v double")), ["k"], "v", accuracy=200).toPandas().set_index("k")["median"]
    assert got[8] == 3.5 and 9 not in got.index
    assert all(got[k] == v for k, v in pdf.groupby("k")["v"].median().items())


def test_curve_on_an_even_grid(spark):
    knots, values = calibrate.even_grid(np.array([0.0, 1, 4]), np.array([0.0, 2, -1]), 9)
    df = spark.createDataFrame([(float(x),) for x in (-5, 0, 0.25, 2, 3.9, 4, 9)], "x double")
    got = [r[0] for r in df.select(calibrate.on_grid(F.col("x"), knots, values)).collect()]
    assert got == pytest.approx(np.interp([-5, 0, 0.25, 2, 3.9, 4, 9], knots, values))
    assert df.select(calibrate.on_grid(F.col("x"), np.array([1.0]), np.array([3.0]))).head()[0] == 3.0


def test_functions_in_sql(spark):
    register(spark)
    register(spark)
    got = spark.sql("SELECT d.* FROM (VALUES ('MKRPAGKC'), (NULL), ('')) AS t(s), LATERAL digest(s, 1, 1, 50) d").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "MK"), (1, 1, "MKRPAGK"), (3, 0, "RPAGK"), (3, 1, "RPAGKC"), (8, 0, "C")]
    whole = spark.createDataFrame([("MKRPAGKC",)], "s string").select(F.explode(peptide.digest(F.col("s"), 1, 1, 50))).collect()
    assert {r[0] for r in whole} == {r.peptide for r in got}
    iso = spark.sql("SELECT s, i.* FROM (VALUES ('PEPM(UniMod:35)K'), ('PEP(Unknown:1)K'), ('J'), (NULL)) AS t(s), LATERAL isotope_pattern(s, 3) i").collect()
    assert {r.s for r in iso} == {"PEPM(UniMod:35)K"} and [r.iso for r in iso] == [0, 1, 2] and 0.9 < sum(r.share for r in iso) <= 1
    row = spark.sql("SELECT lowess_predict(2D, array(1D, 3D), array(10D, 30D)) a, lowess_predict(9D, array(1D, 3D), array(10D, 30D)) b, lowess_predict(CAST(NULL AS DOUBLE), array(1D), array(1D)) c, lowess_predict(1D, CAST(NULL AS ARRAY<DOUBLE>), array(1D)) d").head()
    assert (row.a, row.b, row.c, row.d) == (20, 30, None, None)
    row = spark.sql("SELECT nnls(array(array(1D, 0D), array(0D, 1D)), array(3D, -2D)) a, nnls(array(array(1D)), array(1D, 2D)) b, within_ppm(1000.005D, 1000D, 10) c, mass_to_mz(1000D, 2) d").head()
    assert row.a == [3, 0] and row.b is None and row.c and row.d == pytest.approx(501.007276466621)
