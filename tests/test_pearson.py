"""p-values of Pearson's r against printed critical values and the integral of the t distribution."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.operators.traces import beta_share, log_gamma, pearson_p


def integral(r: float, n: int) -> float:
    """Twice the density of r beyond |r|, (1 - r^2)^((n-4)/2) over its whole, by fine steps in the angle."""
    def area(a):
        x = np.linspace(a, math.pi / 2, 200_001)
        return np.trapezoid(np.cos(x) ** (n - 3), x)

    return area(math.asin(abs(r))) / area(0)


def test_against_the_integral(spark):
    rows = [(r, n) for n in (3, 4, 5, 10, 30, 200, 5000) for r in (0.0, 0.01, -0.2, 0.5, -0.9, 0.999)]
    df = spark.createDataFrame(rows, "r double, n int")
    for x in df.select("r", "n", pearson_p(F.col("r"), F.col("n")).alias("p")).collect():
        assert x.p == pytest.approx(integral(x.r, x.n), rel=1e-6, abs=1e-12), (x.r, x.n)


def test_printed_critical_values(spark):
    rows = [(0.632, 10, 0.05), (0.765, 10, 0.01), (0.444, 20, 0.05), (0.361, 30, 0.05), (0.997, 3, 0.05)]
    for x in spark.createDataFrame(rows, "r double, n int, p double").withColumn("got", pearson_p(F.col("r"), F.col("n"))).collect():
        assert x.got == pytest.approx(x.p, abs=0.0015)


def test_odd_values(spark):
    df = spark.createDataFrame([(0.5, 2), (None, 9), (float("nan"), 9), (1.0, 9), (-1.0, 3), (0.0, 9)], "r double, n int")
    assert [x[0] for x in df.select(pearson_p(F.col("r"), F.col("n"))).collect()] == [None, None, None, 0, 0, pytest.approx(1)]
    got = spark.createDataFrame([(0.5,), (1.0,), (7.25,), (1e5,)], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in got)
    assert spark.range(1).select(beta_share(F.lit(0.3), F.lit(2.0), F.lit(5.0))).head()[0] == pytest.approx(0.579825, abs=1e-6)
