"""Goodness features of a match, aggregated over its matched rows.

Rows: scan_num, prec_id, name, ion, idx, mz, centre (observed m/z), coeff, v (library intensity), o (observed), p (predicted by the
precursor), pt (predicted by all precursors of the row), shared (precursors in the row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .traces import pearson


def log_factorial(n: Column) -> Column:
    """ln(n!) for any n: the sum of logarithms."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), n).cast("int")), F.lit(0.0), lambda a, i: a + F.ln(i)))


def hyperscore(dot: Column, b: Column, y: Column) -> Column:
    return F.greatest(F.lit(0.0), F.ln(dot) + log_factorial(b) + log_factorial(y))


def scribe(v: Column, o: Column) -> Column:
    """Squared distance of two arrays' square roots, each scaled to sum 1."""
    roots = lambda a: F.transform(a, lambda x: F.sqrt(x))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rv, ro = roots(v), roots(o)
    return F.aggregate(F.zip_with(rv, ro, lambda a, b: F.pow(F.try_divide(a, total(rv)) - F.try_divide(b, total(ro)), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def manhattan(p: Column, o: Column) -> Column:
    """-log2 of the summed distance as a share of the observed sum; null where either is 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ratio = F.try_divide(total(F.zip_with(p, o, lambda a, b: F.abs(a - b))), total(o))
    return F.when(ratio > 0, -F.log2(ratio))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def contrast(p: Column, o: Column) -> Column:
    """The square root of the dot product over the product of norms: kept as it is defined, not a cosine."""
    return F.sqrt(_dot(p, o)) / (F.sqrt(_dot(p, p)) * F.sqrt(_dot(o, o)) + 1e-10)


def spectral_angle(a: Column, b: Column) -> Column:
    return 1 - 2 * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a, b)))) / F.lit(3.141592653589793)


def gof(residuals: Column, fitted: Column) -> Column:
    """log2 of summed absolute residuals over the fitted sum, zeros lifted to 1e-6."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    lift = lambda x: F.when(x == 0, F.lit(1e-6)).otherwise(x)
    return F.log2(lift(total(residuals)) / lift(total(fitted)))


def largest_residual(residuals: Column, observed: Column, fitted: Column, matched: bool = True) -> Column:
    keep = F.filter(F.arrays_zip(residuals.alias("r"), observed.alias("o")), lambda x: (x["o"] > 1e-6) if matched else (x["o"] < 1e-6))
    top = F.coalesce(F.array_max(F.transform(keep, lambda x: F.abs(x["r"]))), F.lit(0.0))
    return F.log2(top / (F.aggregate(fitted, F.lit(0.0), lambda s, x: s + x) + 1e-10) + 1e-10)


def scan_shares(rows: DataFrame, tic: str = "tic", significant: float = 1.0) -> DataFrame:
    """(scan_num, frac_int_matched, frac_int_pred, frac_int_matched_pred, frac_int_matched_pred_sigcoeff): what a scan's matched peaks, each once,
    and its predictions are of its total current; predictions of coefficients above `significant` alone; shares of nothing are null."""
    seen, predicted = F.sum(F.col("o") / F.col("shared")), F.sum("p")
    sig = F.coalesce(F.sum(F.when(F.col("coeff") > significant, F.col("p"))), F.lit(0.0))
    return rows.groupBy("scan_num").agg(
        F.try_divide(seen, F.first(tic)).alias("frac_int_matched"),
        F.try_divide(predicted, F.first(tic)).alias("frac_int_pred"),
        F.try_divide(predicted, seen).alias("frac_int_matched_pred"),
        F.try_divide(sig, seen).alias("frac_int_matched_pred_sigcoeff"),
    )


def fragment_cosines(rows: DataFrame) -> DataFrame:
    """(scan_num, prec_id, frag_cosine, frag_pearson) of observed and library intensities; Pearson's r is null below two points or without spread."""
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    got = rows.groupBy("scan_num", "prec_id").agg(F.try_divide(dot("o", "v"), F.sqrt(dot("o", "o")) * F.sqrt(dot("v", "v"))).alias("frag_cosine"), pearson("o", "v").alias("r"))
    return got.select("scan_num", "prec_id", "frag_cosine", F.nanvl("r", F.lit(None).cast("double")).alias("frag_pearson"))


def match_features(rows: DataFrame, tic: str = "tic") -> DataFrame:
    """One row per (scan_num, prec_id) with the features and, as arrays in order of fragment m/z, the matched fragments."""
    lone = F.col("shared") == 1
    got = rows.groupBy("scan_num", "prec_id").agg(
        F.count("*").alias("num_lib"),
        F.sum("v").alias("frac_lib_int"),
        (F.sum("o") / F.first(tic)).alias("frac_dia_int"),
        F.count_if(F.col("ion") == "b").alias("b_counts"),
        F.count_if(F.col("ion") == "y").alias("y_counts"),
        F.max(F.when(F.col("ion").isin("b", "y"), F.col("idx"))).alias("longest_y"),
        F.sum(F.col("v") * F.col("o")).alias("_dot"),
        F.try_divide(F.sum(F.when(lone, F.col("p"))), F.sum(F.when(lone, F.col("o")))).alias("frac_int_uniq"),
        F.try_divide(F.sum("v") * F.first("coeff"), F.sum("o") / F.first(tic)).alias("frac_int_uniq_pred"),
        F.first("coeff").alias("_coeff"),
        F.array_sort(F.collect_list(F.struct("mz", "name", "centre", "v", "o", "p", "pt", "shared"))).alias("_rows"),
    )
    pick = lambda c: F.transform("_rows", lambda s: s[c])
    unique = lambda c: F.transform(F.filter("_rows", lambda s: s["shared"] == 1), lambda s: s[c])
    r = F.transform("_rows", lambda s: s["o"] - s["pt"])
    strong = F.transform("_rows", lambda s: F.when(F.col("_coeff") < 1, F.lit(0.0)).otherwise(s["p"]))
    out = got.withColumns(
        {
            "hyperscore": hyperscore(F.col("_dot"), F.col("b_counts"), F.col("y_counts")),
            "scribe": scribe(pick("v"), pick("o")),
            "manhattan": manhattan(pick("p"), pick("o")),
            "contrast": contrast(pick("p"), pick("o")),
            "cosine": F.coalesce(cosine(strong, pick("o")), F.lit(0.0)),
            "gof": gof(r, pick("p")),
            "max_matched_residual": largest_residual(r, pick("o"), pick("p")),
            "max_unmatched_residual": largest_residual(r, pick("o"), pick("p"), matched=False),
            "spec_r2": F.lit(0.0),
            "prec_r2": F.lit(0.0),
            "prec_r2_uniq": F.lit(0.0),
            "frag_names": pick("name"),
            "frag_errors": F.transform("_rows", lambda s: (s["centre"] - s["mz"]) / s["mz"]),
            "frag_mz": pick("mz"),
            "frag_int": pick("v"),
            "obs_int": pick("o"),
            "unique_frag_mz": unique("mz"),
            "unique_obs_int": unique("o"),
        }
    ).drop("_rows", "_dot", "_coeff")
    return out.join(scan_shares(rows, tic), "scan_num")
