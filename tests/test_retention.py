"""The retention predictor: exact on what its features span, better than a poor library, and chosen only then."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.operators import retention


@pytest.fixture(scope="module")
def matches(spark):
    r = np.random.default_rng(8)
    weight = dict(zip(retention.LETTERS, r.normal(0, 1, 20)))
    rows = []
    for _ in range(1500):
        seq = "".join(r.choice(list(retention.LETTERS), r.integers(7, 25)))
        rt = 20 + sum(weight[a] for a in seq) + 2 * weight[seq[0]] - weight[seq[-1]] + 0.5 * sum(a in "FWY" and b in "DE" for a, b in zip(seq, seq[1:]))
        seen = rt + r.normal(0, 0.2)
        rows.append((seq, float(seen), float(rt + r.normal(0, 3)), float(seen + r.normal(0, 0.05))))
    return spark.createDataFrame(rows, "seq string, rt double, poor double, good double").cache()


def test_held_out_errors(spark, matches):
    fold = F.pmod(F.xxhash64("seq"), F.lit(4))
    model = retention.fit(matches.where(fold != 0), "seq", "rt")
    off = matches.where(fold == 0).select(F.abs(F.col("rt") - model(F.col("seq"))).alias("e"), F.abs(F.col("rt") - F.col("poor")).alias("p")).toPandas()
    assert off.e.median() < 0.3 < 1.5 < off.p.median()
    odd = spark.createDataFrame([("",), ("A",), (None,), ("x?",)], "s string").select(model(F.col("s"))).collect()
    assert [x[0] is None for x in odd] == [False, False, True, False]


def test_the_better_one_is_chosen(matches):
    assert retention.chosen(matches, F.col("poor"), "seq", "rt") is not None
    assert retention.chosen(matches, F.col("good"), "seq", "rt") is None
    assert retention.chosen(matches.limit(50), F.col("poor"), "seq", "rt") is None
    with pytest.raises(ValueError, match="learn from"):
        retention.fit(matches.where("false"), "seq", "rt")


def test_query_equals_dense_ridge(spark):
    import os

    from ionframe.plans.domain_queries import parts, retention_times

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    rows = parts(spark, sf).select("p_partkey", retention.features(F.col("seq")).alias("x"), "p_retailprice").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.p_retailprice for r in rows], float)
    penalty = np.diag([1e-9] + [1.0] * (x.shape[1] - 1))
    want = x @ np.linalg.solve(x.T @ x + penalty, x.T @ y)
    got = {r.p_partkey: r.predicted for r in retention_times(spark, sf).collect()}
    assert len(got) == len(rows) and all(abs(got[r.p_partkey] - v) < 0.01 for r, v in zip(rows, want))
