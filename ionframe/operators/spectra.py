"""Peak tables: merging, tolerance bins, fragment matching, candidates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import range_join, tolerance_join


def merge_peaks(peaks: DataFrame, mz: str, intensity: str, tol: float, on: list[str]) -> DataFrame:
    """(key, anchor, intensity, n): each peak goes to the leftmost peak within the relative tolerance
    below it (one hop, not the chain), and intensities of an anchor add up. Zero peaks and
    non-positive m/z are dropped first."""
    keys = ", ".join(f"`{c}`" for c in on)
    anchor = F.expr(f"min(`{mz}`) over (partition by {keys} order by ln(`{mz}`) range between {math.log1p(tol)!r}D preceding and current row)")
    return peaks.where((F.col(mz) > 0) & (F.col(intensity) > 0)).withColumn("anchor", anchor).groupBy(*on, "anchor").agg(F.sum(intensity).alias(intensity), F.count("*").alias("n"))


def tolerance_bins(centres: DataFrame, mz: str, tol: float, on: list[str]) -> DataFrame:
    """(key, k, lo, hi): all centres' edges in order, paired one after another; overlapping bins
    are cut anew by this, so bin k need not hold centre k."""
    edges = centres.select(*on, F.explode(F.array(F.col(mz) * (1 - tol), F.col(mz) * (1 + tol))).alias("edge"))
    ranked = edges.withColumn("_rn", F.row_number().over(Window.partitionBy(*on).orderBy("edge")) - 1)
    return ranked.groupBy(*on, F.floor(F.col("_rn") / 2).alias("k")).agg(F.min("edge").alias("lo"), F.max("edge").alias("hi"))


def normalised(fragments: DataFrame, intensity: str, on: list[str], out: str = "norm_int") -> DataFrame:
    return fragments.withColumn(out, F.col(intensity) / F.sum(intensity).over(Window.partitionBy(*on)))


def top_ranks(df: DataFrame, order: list, on: list[str], out: str = "top_rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*on).orderBy(*order)))


def candidates(scans: DataFrame, library: DataFrame, rt_tol: float, mz_width: float = 1.0) -> DataFrame:
    """Precursors of each MS2 scan: |prec_mz - target| < half the isolation width and |rt - irt| < rt_tol.

    scans: scan_num, rt, prec_mz, win_lo, win_hi; library: prec_id, prec_mz, irt and others."""
    half = (F.col("win_hi") - F.col("win_lo")) / 2
    windows = scans.select("scan_num", F.col("rt").alias("scan_rt"), (F.col("prec_mz") - half).alias("_lo"), (F.col("prec_mz") + half).alias("_hi"))
    return range_join(library, "prec_mz", windows, "_lo", "_hi", mz_width, open_hi=True).where(F.abs(F.col("irt") - F.col("scan_rt")) < rt_tol).drop("_lo", "_hi")


def match_fragments(cands: DataFrame, fragments: DataFrame, bins: DataFrame, mz_width: float = 0.05) -> DataFrame:
    """Fragments of candidate precursors in a scan's bins (lo < mz <= hi): columns of all three."""
    return range_join(cands.join(fragments, "prec_id"), "mz", bins, "lo", "hi", mz_width, on=["scan_num"])


def accepted(matches: DataFrame, share: float = 0.5, least: int = 3, top: int = 10) -> DataFrame:
    """(scan_num, prec_id, matched, n_top): matched norm_int above share and more than `least` of the top fragments."""
    agg = matches.groupBy("scan_num", "prec_id").agg(F.sum("norm_int").alias("matched"), F.count_if(F.col("top_rank") <= top).alias("n_top"))
    return agg.where((F.col("matched") > share) & (F.col("n_top") > least))


def first_search_accepted(matches: DataFrame, share: float = 0.8, least: int = 3, top: int = 10) -> DataFrame:
    """As accepted, and the strongest fragment and two of the three strongest are matched."""
    agg = matches.groupBy("scan_num", "prec_id").agg(F.sum("norm_int").alias("matched"), F.count_if(F.col("top_rank") <= top).alias("n_top"), F.count_if(F.col("top_rank") == 1).alias("_one"), F.count_if(F.col("top_rank") <= 3).alias("_three"))
    return agg.where((F.col("matched") > share) & (F.col("n_top") > least) & (F.col("_one") >= 1) & (F.col("_three") >= 2)).drop("_one", "_three")


def feature_candidates(features: DataFrame, library: DataFrame, rel: float) -> DataFrame:
    """Library precursors within a relative tolerance, strict, of each survey feature's m/z, and of its charge.
    features: feature_id, mz, charge and others; library: prec_id, prec_mz, charge and others."""
    hit = tolerance_join(library, "prec_mz", features, "mz", 2 * rel, on=["charge"])
    return hit.where(F.abs(F.col("prec_mz") - F.col("mz")) / F.col("mz") < rel)


def seeded_sample(df: DataFrame, n: int, on: list[str], seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer, chosen by a hash of the columns `on` and a seed: the same ones in every run."""
    return df.orderBy(F.xxhash64(*on, F.lit(seed)), *on).limit(n)


def probe_scans(scans: DataFrame, per_part: int = 40, parts: int = 10) -> DataFrame:
    """The scans with most TIC in each of `parts` equal shares of the run."""
    part = scans.withColumn("part", F.ntile(parts).over(Window.partitionBy("run").orderBy("rt", "scan_num")))
    return top_ranks(part, [F.desc("tic"), "scan_num"], ["run", "part"], "_r").where(F.col("_r") <= per_part).drop("_r")


def dense_values(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Rows inside the span of histogram bins that hold more than half the mean non-empty count."""
    span = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    own = df.join(F.broadcast(span), how="cross").withColumn("_k", F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins)))  # one row
    counts = own.groupBy("_k").agg(F.count("*").alias("c"))
    dense = counts.join(F.broadcast(counts.agg(F.avg("c").alias("m"))), how="cross").where("c > m / 2").agg(F.min("_k").alias("_x"), F.max("_k").alias("_y"))
    return own.join(F.broadcast(dense), how="cross").where("_k between _x and _y").select(*df.columns)
