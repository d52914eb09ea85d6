"""The search as one lazy plan: candidates, peak matching, deconvolution, features, scores, quantities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.peptide import fragment_mz, residues, reverse_decoy_tagged, split_fragment, stripped, substitute_decoy
from ..operators import calibrate, local, quant, scoring, spectra
from ..operators.features import match_features
from ..operators.solve import deconvolve
from ..shared import stored


@dataclass(frozen=True)
class Config:
    """Search settings; calibration returns new values instead of changing these."""

    mz_tol: float = 10e-6
    ms1_tol: float = 20e-6
    rt_tol: float = 9.0
    share: float = 0.5
    first_share: float = 0.8
    score_lib_frac: float = 0.5
    least_coeff: float = 100.0
    tag: str | None = None
    decoys: str = "rev"
    ms1_required: bool = True
    probe_per_part: int = 40
    probe_parts: int = 10
    least_top: int = 3
    top: int = 10
    nearby: int = 2
    isotopes: int = 6
    predict_rt: bool = True
    predict_least: int = 1000
    q_threshold: float = 0.01
    folds: int = 5
    trees: int = 200
    depth: int = 20
    model: str = "rf"


def add_decoys(library: DataFrame, rule: str = "rev", tag: str = "mTRAQ") -> DataFrame:
    """The library and its decoys: residues reversed but for the last (rev; modifications travel, the tag's marks stay in place) or exchanged for look-alikes
    (substitute), b and y m/z computed anew, intensities kept. Ions other than b and y, unknown residues and unknown modifications raise."""
    t = residues(F.col("mod_seq"))
    decoy = library.withColumns({"_t": substitute_decoy(t) if rule == "substitute" else reverse_decoy_tagged(t, tag)})
    f = lambda x: split_fragment(x["name"])
    moved = F.transform("frags", lambda x: F.struct(F.coalesce(fragment_mz(F.col("_t"), f(x)["ion"], f(x)["idx"], f(x)["charge"], f(x)["loss"]), F.raise_error(F.concat(F.lit("no decoy m/z for "), x["name"])).cast("double")).alias("mz"), x["intensity"].alias("intensity"), x["name"].alias("name")))
    decoy = decoy.withColumns({"frags": F.array_sort(moved), "mod_seq": F.array_join("_t", "")}).withColumns({"seq": stripped(F.col("mod_seq")), "is_decoy": F.lit(True)}).drop("_t")
    return library.unionByName(decoy)


def search(scans: DataFrame, fragments: DataFrame, precursors: DataFrame, config: Config = Config(), survey: DataFrame | None = None, first: bool = False) -> DataFrame:
    """One row per (scan, precursor) with a positive coefficient, and its features.

    scans: scan_num, rt, prec_mz, win_lo, win_hi, tic, mz[], intensity[]; precursors: prec_id, prec_mz, irt (in run time), is_decoy;
    fragments: prec_id, name, ion, idx, mz, norm_int, top_rank. Targets and decoys have distinct prec_id and are solved together.
    survey: all scans of the runs (run, scan_num, ms_level, rt, mz[], intensity[]); with it a candidate needs a peak of its m/z in the nearest survey scan, and has
    that peak's mz_error. first: the stricter acceptance of a first search.
    """
    peaks = scans.select("scan_num", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("scan_num", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
    merged = spectra.merge_peaks(peaks, "mz", "intensity", config.mz_tol, ["scan_num"]).withColumnRenamed("anchor", "centre").withColumnRenamed("intensity", "o")
    own = merged.withColumns({"lo": F.col("centre") * (1 - config.mz_tol), "hi": F.col("centre") * (1 + config.mz_tol)}).withColumn("row", F.row_number().over(Window.partitionBy("scan_num").orderBy("centre")))
    cands = spectra.candidates(scans, precursors, config.rt_tol).select("scan_num", "prec_id", "scan_rt", "is_decoy", F.col("prec_mz"), F.col("irt"))
    if survey is not None:
        cands = cands.join(quant.survey_errors(cands, survey, config.ms1_tol), ["scan_num", "prec_id"])
    else:
        cands = cands.withColumn("mz_error", F.lit(None).cast("double"))
    hits = spectra.match_fragments(cands, fragments.select("prec_id", "name", "ion", "idx", "mz", "norm_int", "top_rank"), own)
    near = Window.partitionBy("scan_num", "prec_id", "name").orderBy(F.abs(F.col("centre") - F.col("mz")), "row")
    hits = hits.withColumn("_n", F.row_number().over(near)).where("_n = 1").drop("_n")  # a fragment takes its nearest peak
    accept = spectra.first_search_accepted if first else spectra.accepted
    good = accept(hits, config.first_share if first else config.share, config.least_top, config.top).select("scan_num", "prec_id")
    hits = hits.join(good, ["scan_num", "prec_id"])
    missing = cands.join(good, ["scan_num", "prec_id"]).join(fragments.select("prec_id", "name", "norm_int"), "prec_id").join(hits.select("scan_num", "prec_id", "name"), ["scan_num", "prec_id", "name"], "left_anti")
    zero = missing.where("norm_int > 1e-10").select("scan_num", (-F.row_number().over(Window.partitionBy("scan_num").orderBy("prec_id", "name"))).alias("row"), "prec_id", F.col("norm_int").alias("v"), F.lit(0.0).alias("o"))
    coeff = deconvolve(hits.select("scan_num", "row", "prec_id", F.col("norm_int").alias("v"), "o"), zero).where("coeff > 0")
    rows = hits.join(coeff, ["scan_num", "prec_id"]).withColumn("p", F.col("norm_int") * F.col("coeff"))
    row = Window.partitionBy("scan_num", "row")
    rows = rows.withColumns({"pt": F.sum("p").over(row), "shared": F.count("*").over(row), "v": F.col("norm_int")}).join(scans.select("scan_num", "tic"), "scan_num")
    head = rows.groupBy("scan_num", "prec_id").agg(F.first("coeff").alias("coeff"), F.first("is_decoy").alias("is_decoy"), F.first("scan_rt").alias("rt"), (F.first("scan_rt") - F.first("irt")).alias("rt_error"), F.first("mz_error").alias("mz_error"))
    return head.join(match_features(rows), ["scan_num", "prec_id"])


FEATURES = ["num_lib", "frac_lib_int", "frac_dia_int", "b_counts", "y_counts", "longest_y", "hyperscore", "scribe", "manhattan", "contrast", "cosine", "gof", "max_matched_residual", "rt_error", "mz_error", "med_frag_error", "frac_int_matched", "frac_int_pred", "frac_int_matched_pred", "frac_int_uniq", "frac_int_matched_pred_sigcoeff", "sq_rt_error", "sq_mz_error", "manhattan_nearby", "gof_nearby", "max_matched_nearby"]


def best_matches(psm: DataFrame, nearby: int = 2, on: list[str] | None = None) -> DataFrame:
    """The row with the largest coefficient per precursor (and whatever else `on` names), with extremes of features in the scans around it."""
    key = on or ["prec_id"]
    out = scoring.best_rows(psm, key, [F.desc("coeff"), "scan_num"])
    for name, how, as_ in (("manhattan", "max", "manhattan_nearby"), ("gof", "min", "gof_nearby"), ("max_matched_residual", "min", "max_matched_nearby")):
        near = scoring.nearby_extreme(psm, key, ["rt", "scan_num"], [F.desc("coeff"), "scan_num"], name, nearby, how, as_).drop("n")
        out = out.join(near, key, "left")
    return out.withColumns({"sq_rt_error": F.col("rt_error") * F.col("rt_error"), "sq_mz_error": F.col("mz_error") * F.col("mz_error")})


def score(best: DataFrame, group: str, config: Config = Config()) -> DataFrame:
    """Cross-validated scores and q-values; the label is a target with a coefficient above 1, and the coefficient isn't a feature.
    Scores are stored before ranks are taken, so that ties and order are the same in every pass."""
    df = best.withColumn("label", (~F.col("is_decoy") & (F.col("coeff") > 1)).cast("int")).withColumns({c: F.col(c).cast("double") for c in FEATURES})
    scored = stored(scoring.cross_validated(df, FEATURES, "label", group, config.folds, config.model, config.trees, config.depth), "scored")
    return scoring.qvalues(scored, F.col("is_decoy"), "score", ["prec_id", "scan_num"])


def calibration_matches(psm: DataFrame, library: DataFrame, least_coeff: float = 100.0, percentile: float = 0.8, survey: DataFrame | None = None, ms1_tol: float = 20e-6) -> DataFrame:
    """The targets that a first search is calibrated on: each precursor's best match with a coefficient above least_coeff and a hyperscore in the
    upper part of these (prec_id, scan_num, coeff, irt, rt, prec_mz, ms1_error, frag_mz, frag_errors).

    ms1_error is the signed relative error of the peak nearest the precursor in the survey scan nearest the match; null without such a peak, or without survey.
    """
    best = scoring.best_rows(psm.where(~F.col("is_decoy") & (F.col("coeff") > least_coeff)), ["prec_id"], [F.desc("coeff"), "scan_num"]).join(library.select("prec_id", "irt", "prec_mz"), "prec_id")
    bound = best.agg(F.percentile("hyperscore", 1 - percentile).alias("_b"))  # one row
    got = best.join(F.broadcast(bound), F.col("hyperscore") >= F.col("_b")).select("prec_id", "scan_num", "coeff", "irt", "rt", "prec_mz", "frag_mz", "frag_errors")
    if survey is None:
        return got.withColumn("ms1_error", F.lit(None).cast("double"))
    errors = quant.survey_errors(got.select("scan_num", "prec_id", "prec_mz"), survey, ms1_tol).withColumnRenamed("mz_error", "ms1_error")
    return got.join(errors, ["scan_num", "prec_id"], "left")


def _mass_curves(df: DataFrame, mz: str, error: str, frac: float) -> tuple[calibrate.Curve, calibrate.Curve, float]:
    """Curves of a relative error on run time and, of its rest, on m/z, and four sigma of what is left. Without rows nothing is corrected."""
    pack = lambda k: tuple(tuple(float(v) for v in a) for a in k)
    none = ((0.0,), (0.0,))
    if df.isEmpty():
        return none, none, float("inf")
    by_rt = local.curve(local.local_regression(df, "rt", error, frac))
    left = df.withColumn("_left", local.residual("rt", error, by_rt))
    by_mz = local.curve(local.local_regression(left, mz, "_left", frac))
    rest = stored(left.select(local.residual(mz, "_left", by_mz).alias("e")), "rest")
    return pack(by_rt), pack(by_mz), 4 * local.gaussian_width(rest, "e")


def probe_calibration(matches: DataFrame, frac: float = 0.2) -> calibrate.Calibration:
    """Curves and tolerances from the matches of a first search (calibration_matches): run time on library time, survey errors and fragment errors on time and m/z. All matches
    take part; the driver gets knots, quantiles and histograms. The tolerance of fragments follows from single fragments' errors."""
    matches = stored(matches, "matches")
    if matches.isEmpty():
        raise ValueError("the first search found nothing to calibrate on; widen the tolerances or lower least_coeff")
    curve = local.curve(local.local_regression(matches, "irt", "rt", frac))
    off = matches.select(F.abs(local.residual("irt", "rt", curve)).alias("e")).agg(F.percentile_approx("e", [i / 1000 for i in range(1, 1000)], 100_000)).head()[0]
    ms1 = _mass_curves(matches.where("ms1_error is not null"), "prec_mz", "ms1_error", frac)
    frags = matches.select("rt", F.explode(F.arrays_zip("frag_mz", "frag_errors")).alias("f")).select("rt", "f.frag_mz", "f.frag_errors")
    ms2 = _mass_curves(frags, "frag_mz", "frag_errors", frac)
    return calibrate.Calibration(tuple(tuple(float(v) for v in a) for a in curve), ms1[0], ms1[1], ms2[0], ms2[1], calibrate.error_boundary(off)[0], ms1[2], ms2[2])
