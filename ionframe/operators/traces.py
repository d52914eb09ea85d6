"""Traces: areas, smoothing, interpolation, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(a: str, b: str):
    """Pearson's r as an aggregate; null, not an error, where one side doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


# Coefficients of Lanczos' approximation of the gamma function for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5, to about 1e-14."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + F.lit(c) / (x + i)
    t = x + 6.5
    return F.lit(0.9189385332046727) + (x - 0.5) * F.ln(t) - t + F.ln(series)


def beta_share(x: Column, a: Column, b: Column, terms: int = 200) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b >= 0.5 by its continued fraction, on the side where that converges fast."""

    def side(x: Column, a: Column, b: Column) -> Column:
        tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

        def turn(s: Column, i: Column) -> Column:  # one even and one odd step
            even = i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i))
            odd = -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))
            d1, c1 = 1 / tiny(1 + even * s["d"]), tiny(1 + even / s["c"])
            d2, c2 = 1 / tiny(1 + odd * d1), tiny(1 + odd / c1)
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

        first = 1 / tiny(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a
        return front * F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda i: i.cast("double")), start, turn)["h"]

    near = x < (a + 1) / (a + b + 2)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(near, side(x, a, b)).otherwise(1 - side(1 - x, b, a))


def pearson_p(r: Column, n: Column) -> Column:
    """The two-sided p-value of Pearson's r over n points: how often unrelated values would have one as large. Null below three points or without an r."""
    p = beta_share(F.greatest(F.lit(0.0), 1 - r * r), (n - 2) / F.lit(2.0), F.lit(0.5))
    return F.when((n >= 3) & ~F.isnan(r) & r.isNotNull(), p)


def trapezoid(df: DataFrame, on: list[str], x: str, y: str, out: str = "area") -> DataFrame:
    """(key, out): trapezoid area of y over x; 0 for a single point."""
    w = Window.partitionBy(*on).orderBy(x)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_s", step).groupBy(*on).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias(out))


def apex_area(df: DataFrame, on: list[str], x: str, y: str, out: str = "apex") -> DataFrame:
    """(key, out): the largest y (the earliest of equals) and its two neighbours, added."""
    w = Window.partitionBy(*on).orderBy(x)
    own = df.withColumn("_a", F.col(y) + F.coalesce(F.lag(y).over(w), F.lit(0.0)) + F.coalesce(F.lead(y).over(w), F.lit(0.0)))
    return own.groupBy(*on).agg(F.max_by("_a", F.struct(F.col(y), (-F.col(x)).alias("_x"))).alias(out))


def moving_average(df: DataFrame, on: list[str], x: str, y: str, width: int = 3, out: str = "smooth") -> DataFrame:
    """Sum of the window around each point divided by width: beyond the ends count zeros."""
    w = Window.partitionBy(*on).orderBy(x).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(out, F.sum(y).over(w) / width)


def moving_area(df: DataFrame, on: list[str], x: str, y: str, step: float, width: int = 3, out: str = "area") -> DataFrame:
    """The sum of the window of `width` points that is centred on each, times the step: beyond the ends count zeros."""
    w = Window.partitionBy(*on).orderBy(x).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn(out, F.sum(y).over(w) * step)


def fragment_traces(psm: DataFrame, on: list[str]) -> DataFrame:
    """(key, fragment, trace): each fragment's (scan_num, mz, obs) over the scans of a key, in order of scan. psm: key, scan_num, frag_names, frag_mz, obs_int."""
    rows = psm.select(*on, "scan_num", F.explode(F.arrays_zip("frag_names", "frag_mz", "obs_int")).alias("f"))
    one = F.struct("scan_num", F.col("f.frag_mz").alias("mz"), F.col("f.obs_int").alias("obs"))
    return rows.groupBy(*on, F.col("f.frag_names").alias("fragment")).agg(F.array_sort(F.collect_list(one)).alias("trace"))


def interpolate(points: DataFrame, knots: DataFrame, on: list[str], x: str, y: str, out: str = "interpolated") -> DataFrame:
    """points with the knots' linear interpolation at x, null outside; one sort of the union."""
    a = points.withColumns({"_k": F.lit(None).cast("struct<x:double,y:double>"), "_side": F.lit(1)})
    k = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    b = knots.select(*[F.col(c) if c in [*on, x] else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns], k.alias("_k"), F.lit(0).alias("_side"))
    ahead = (Window.unboundedPreceding, Window.currentRow)  # frames that only grow: one pass each
    w, v = Window.partitionBy(*on).orderBy(F.asc(x)).rangeBetween(*ahead), Window.partitionBy(*on).orderBy(F.desc(x)).rangeBetween(*ahead)
    both = a.unionByName(b).withColumns({"_l": F.max("_k").over(w), "_h": F.min("_k").over(v)}).where("_side = 1")
    lx, hx = F.col("_l.x"), F.col("_h.x")
    value = F.when(lx == hx, F.col("_l.y")).when(lx.isNotNull() & hx.isNotNull(), F.col("_l.y") + (F.col("_h.y") - F.col("_l.y")) * (F.col(x) - lx) / (hx - lx))
    return both.withColumn(out, value).select(*points.columns, out)


def isotope_fit(df: DataFrame, on: list[str], theory: str, observed: str) -> DataFrame:
    """(key, slope, r): slope through the origin of observed on theory, and Pearson's r."""
    return df.groupBy(*on).agg(F.try_divide(F.sum(F.col(theory) * F.col(observed)), F.sum(F.col(theory) * F.col(theory))).alias("slope"), pearson(theory, observed).alias("r"))


def trace_product(*correlations: str):
    p = F.col(correlations[0])
    for c in correlations[1:]:
        p = p * F.col(c)
    return F.when(p + 1e-6 > 0, F.log10(p + 1e-6))
