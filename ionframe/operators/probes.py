"""Survey features, probe filters, unmatched rows and time channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import nearest_holding
from .ranks import exact_quantiles


def within_tolerance(x: Column, y: Column, rel: float, absolute: float = 0.0) -> Column:
    """|x - y| <= absolute + rel * |y|."""
    return F.abs(x - y) <= absolute + rel * F.abs(y)


def feature_filter(features: DataFrame, rt: float, rt_tol: float, centre: float, width: float) -> DataFrame:
    """Features whose apex is near a time and whose m/z is inside a window, both strict."""
    return features.where((F.abs(F.col("rt_apex") - rt) < rt_tol) & (F.abs(F.col("mz") - centre) < width / 2))


def probe_features(features: DataFrame, per_bin: int, bins: int = 5) -> DataFrame:
    """The most intense features of charge 2 or more in each of `bins` equal m/z ranges."""
    own = features.where("charge > 1")
    span = own.agg(F.min("mz").alias("_a"), F.max("mz").alias("_b"))  # one row
    own = own.join(F.broadcast(span), how="cross").withColumn("bin", F.least(F.lit(bins), F.width_bucket("mz", "_a", "_b", F.lit(bins))))
    w = Window.partitionBy("bin").orderBy(F.desc("intensity_apex"), "mz", "rt_apex")
    return own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_bin).drop("_r", "_a", "_b")


def closest_feature(precursors: DataFrame, features: DataFrame, rel: float) -> DataFrame:
    """Each precursor's feature with the nearest m/z among those that span its time and lie within the tolerance;
    null if none. precursors: prec_id, mz, rt; features: feature_id, mz, rt_start, rt_end."""
    p = precursors.select("prec_id", F.col("mz").cast("double").alias("_mz"), F.col("rt").cast("double").alias("_rt"))
    hit = nearest_holding(p, "_rt", "_mz", features, "rt_start", "rt_end", "mz", "feature_id").where(F.col("mz").between(F.col("_mz") * (1 - rel), F.col("_mz") * (1 + rel)))
    # by the absolute difference, the smaller feature_id of equals; the signed one goes along
    best = hit.groupBy("_rt", "_mz").agg(F.min(F.struct(F.abs(F.col("mz") - F.col("_mz")).alias("d"), "feature_id", (F.col("mz") - F.col("_mz")).alias("mz_diff"))).alias("m"))
    best = p.join(best, ["_rt", "_mz"]).select("prec_id", "m.feature_id", "m.mz_diff")
    return precursors.join(best, "prec_id", "left")


def percentile_relaxation(df: DataFrame, high: list[str], low: list[str], outlier: Column, start: int = 20, stop: int = 75, step: int = 5, share: float = 0.05, least: int = 800) -> tuple[DataFrame, int]:
    """Rows above percentile p of the `high` columns and below 100 - p of the `low` ones, for the first p at
    which outliers are under `share` or fewer than `least` rows are left; and that p.

    A column's percentiles come from one count of its values, and the counts at every p from one aggregation.
    """
    steps = list(range(start, stop + 1, step))
    quantiles = {c: exact_quantiles(df, c, [(p if c in high else 100 - p) / 100 for p in steps]) for c in [*high, *low]}
    keep = [F.lit(True) for _ in steps]
    for c in [*high, *low]:
        for i, bound in enumerate(quantiles[c] or [None] * len(steps)):
            keep[i] = keep[i] & ((F.col(c) > F.lit(bound)) if c in high else (F.col(c) < F.lit(bound)))
    counts = df.agg(*[F.count_if(k).alias(f"n{i}") for i, k in enumerate(keep)], *[F.count_if(k & outlier).alias(f"o{i}") for i, k in enumerate(keep)]).head()
    for i, p in enumerate(steps):
        if counts[f"n{i}"] < least or counts[f"o{i}"] < share * counts[f"n{i}"]:
            return df.where(keep[i]), p
    return df.where(keep[-1]), steps[-1]


def unmatched_rows(fragments: DataFrame, kind: str = "c") -> DataFrame:
    """Equations with nothing observed for candidates' fragments without a peak (scan_num, prec_id, name, v).

    a: all of a scan share one; b: one per precursor with the sum; c: one per fragment above 1e-10. Rows are negative, apart from matched ones."""
    if kind == "a":
        return fragments.groupBy("scan_num", "prec_id").agg(F.sum("v").alias("v")).select("scan_num", F.lit(-1).alias("row"), "prec_id", "v", F.lit(0.0).alias("o"))
    w = Window.partitionBy("scan_num").orderBy("prec_id", *(["name", "v"] if kind == "c" else []))
    own = fragments.where("v > 1e-10") if kind == "c" else fragments.groupBy("scan_num", "prec_id").agg(F.sum("v").alias("v"))
    if kind not in "bc":
        raise ValueError("kind must be a, b or c")
    return own.select("scan_num", (-F.row_number().over(w)).alias("row"), "prec_id", "v", F.lit(0.0).alias("o"))


def time_channels(library: DataFrame, n: int) -> DataFrame:
    """The library once per time channel (0..n-1)."""
    return library.withColumn("time_channel", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def channel_count(hits: DataFrame, key: list[str]) -> int:
    """How many time channels a run has: the most common number of hits per precursor (the smaller of equals); 0 without hits."""
    n = hits.groupBy(*key).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    return n.agg(F.coalesce(F.max_by("k", F.struct("c", (-F.col("k")).alias("x"))), F.lit(0))).head()[0]


def consistent_offsets(hits: DataFrame, key: list[str], rt: str, tol: float = 1.0) -> DataFrame:
    """Hits whose time from the precursor's first hit lies within tol of the modal whole-minute offset of their ordinal."""
    w = Window.partitionBy(*key).orderBy(rt)
    own = hits.withColumns({"time_channel": F.row_number().over(w) - 1, "offset": F.col(rt) - F.first(rt).over(w)})
    counts = own.groupBy("time_channel", F.round("offset").alias("_m")).agg(F.count("*").alias("c"))
    mode = counts.groupBy("time_channel").agg(F.max_by("_m", F.struct("c", (-F.col("_m")).alias("x"))).alias("modal"))
    return own.join(F.broadcast(mode), "time_channel").where(F.abs(F.col("offset") - F.col("modal")) <= tol)  # one row per channel


def tolerance_below_spacing(tolerance: float, offsets: list[float]) -> float:
    """A time tolerance cut to less than half the least distance of time channels."""
    gaps = [b - a for a, b in zip(sorted(offsets), sorted(offsets)[1:], strict=False)]
    return min(tolerance, 0.499 * min(gaps)) if gaps else tolerance
