"""From files to identified and quantified precursors: read, first search, calibration, search, scores, quantities, outputs."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.isotopes import patterns
from ..functions.peptide import composition, precursor_key, sibling_channels, stripped, tag_library, untagged
from ..operators import quant, scoring, spectra
from ..operators.calibrate import Calibration
from ..operators.retention import Predictor, chosen
from ..operators.traces import apex_area
from ..shared import stored
from ..sources import readers, writers
from . import search as s


def with_ids(library: DataFrame) -> DataFrame:
    """The library with prec_id, a hash of sequence, charge and kind."""
    return library.withColumn("prec_id", F.xxhash64("mod_seq", "charge", "is_decoy"))


def with_scan_ids(scans: DataFrame) -> DataFrame:
    """Scans with numbers that are unique over runs; the run's own number stays as scan_in_run."""
    return scans.withColumnRenamed("scan_num", "scan_in_run").withColumn("scan_num", F.xxhash64("run", "scan_in_run"))


def first_search(scans: DataFrame, fragments: DataFrame, precursors: DataFrame, config: s.Config) -> tuple[DataFrame, Calibration]:
    """The matches of the probe scans that a calibration rests on, and the calibration. Library times should be near the run's, so that the
    wide tolerance of a first search holds the curve's bends."""
    ms2 = scans.where("ms_level = 2")
    probes = spectra.probe_scans(ms2, config.probe_per_part, config.probe_parts)
    found = stored(s.search(probes, fragments, precursors, config, scans if config.ms1_required else None, first=True), "first")
    matches = stored(s.calibration_matches(found, precursors, config.least_coeff, survey=scans, ms1_tol=config.ms1_tol), "matches")
    return matches, s.probe_calibration(matches)


def calibrated(precursors: DataFrame, scans: DataFrame, calibration: Calibration, config: s.Config, predictor: Predictor | None = None) -> tuple[DataFrame, DataFrame, s.Config]:
    """Precursors with library times turned into run times (or times predicted from their sequences), scans with peaks freed from the instrument's mass error, and
    tolerances that are never wider than those asked for."""
    own = calibration.predicted_rt(F.col("irt"))
    moved = precursors.withColumn("irt", F.coalesce(predictor(stripped(F.col("mod_seq"))), own) if predictor else own)
    peaks = scans.withColumn("mz", calibration.corrected_peaks(F.col("mz"), F.col("rt"), F.col("ms_level")))
    narrow = lambda asked, found, least: min(asked, max(found, least))
    tolerances = {"rt_tol": narrow(config.rt_tol, calibration.rt_tol, 0.05), "ms1_tol": narrow(config.ms1_tol, calibration.ms1_tol, 1e-6), "mz_tol": narrow(config.mz_tol, calibration.mz_tol, 1e-6)}
    return moved, peaks, replace(config, **tolerances)


def identified(psm: DataFrame, scans: DataFrame, precursors: DataFrame, config: s.Config) -> DataFrame:
    """One row per run and precursor: score, q-values of the row, of its best channel and of its protein, channels matched."""
    tag = config.tag or "mTRAQ"
    facts = precursors.select("prec_id", "mod_seq", "seq", "charge", "prec_mz", F.coalesce("protein_group", "protein_name", "seq").alias("protein"))
    own = scoring.with_fragment_medians(psm.join(scans.select("scan_num", "run", "scan_in_run"), "scan_num"), ["run"]).where(F.col("frac_lib_int") >= config.score_lib_frac)
    best = stored(s.best_matches(own, config.nearby, ["run", "prec_id"]).join(facts, "prec_id"), "best")
    got = s.score(best, "seq", config)
    got = got.withColumns({"stripped_seq": stripped(F.col("mod_seq")), "channel": F.coalesce(F.nullif(F.regexp_extract("mod_seq", rf"\({tag}-([^)]*)\)", 1), F.lit("")), F.lit("0")), "untag_prec": precursor_key(untagged(F.col("mod_seq"), tag), F.col("charge"))})
    got = scoring.best_channel_qvalues(scoring.with_channels_matched(got, ["run", "untag_prec", "is_decoy"]), ["run", "untag_prec", "is_decoy"])
    got = stored(got, "identified")
    proteins = scoring.protein_qvalues(got.withColumn("_decoy", F.col("is_decoy").cast("int")), "protein", "_decoy", "score")
    return got.join(proteins, "protein", "left")


def tagged_library(library: DataFrame, tag: str) -> DataFrame:
    """The library once for every channel of a tag, with the m/z of precursors and fragments moved; one that holds tagged sequences already stays as it is."""
    if not library.where(F.col("mod_seq").contains(f"({tag}-")).isEmpty():
        return library
    rest = [c for c in library.columns if c not in ("frags", "mod_seq", "prec_mz")]
    rows = library.select("mod_seq", "prec_mz", *rest, F.explode("frags").alias("_f")).select("mod_seq", "prec_mz", *rest, "_f.mz", "_f.intensity", "_f.name")
    moved = tag_library(rows, tag)
    frags = F.array_sort(F.collect_list(F.struct("mz", "intensity", "name"))).alias("frags")
    return moved.groupBy("mod_seq", "charge", "is_decoy").agg(F.first("prec_mz").alias("prec_mz"), *[F.first(c).alias(c) for c in rest if c not in ("charge", "is_decoy")], frags).select(*library.columns)


def channel_amounts(ids: DataFrame, scans: DataFrame, config: s.Config) -> DataFrame:
    """(run, untag_prec, channel, plex_fit, plex_area): for each precursor with an identified channel the amounts of all channels of its tag, fitted together
    to the survey scans around the best channel's match: the largest, and it with its two neighbours."""
    best = scoring.best_rows(ids, ["run", "untag_prec"], [F.desc("coeff"), "scan_num"]).select("run", "untag_prec", "scan_num", "mod_seq", "charge", "prec_mz")
    near = quant.nearest_survey(scans.select("run", "scan_num", "ms_level", "rt")).select("run", "scan_num", F.col("ms1_rt").alias("rt"))
    apex = best.join(near, ["run", "scan_num"]).join(scans.where("ms_level = 1").select("run", "rt", F.col("scan_num").alias("ms1_scan")), ["run", "rt"])
    atoms = F.coalesce(composition(untagged(F.col("mod_seq"), config.tag)), composition(stripped(F.col("mod_seq"))))
    own = patterns(apex.select("run", "untag_prec", "ms1_scan", "mod_seq", "charge", "prec_mz", atoms.alias("_atoms")), "_atoms", config.isotopes).drop("_atoms")
    member = F.struct(F.col("sibling").alias("channel"), F.col("prec_mz").alias("mz"), F.col("charge").alias("z"), "isotopes")
    groups = sibling_channels(own, config.tag).groupBy("run", "untag_prec", "ms1_scan").agg(F.array_sort(F.collect_list(member)).alias("members"))
    groups = stored(groups.withColumn("group", F.xxhash64("untag_prec")), "groups")
    traces = quant.channel_traces(groups, scans, config.ms1_tol)
    key = ["run", "group", "channel"]
    amounts = apex_area(traces, key, "ms1_rt", "amount", "plex_area").join(traces.groupBy(*key).agg(F.max("amount").alias("plex_fit")), key)
    return amounts.join(groups.select("run", "group", "untag_prec"), ["run", "group"]).select("run", "untag_prec", "channel", "plex_fit", "plex_area")


QUANTITIES = ["ms1_area", "ms1_int", "iso_cor", "peak_area", "ms1_cor", "traceproduct"]


def quantified(ids: DataFrame, scans: DataFrame, config: s.Config, psm: DataFrame | None = None) -> DataFrame:
    """ids with survey-scan quantities of the targets whose best channel passes the q-value threshold; the others have 0. psm: all
    matches, for the correlation of survey traces with coefficients."""
    wanted = ids.where(~F.col("is_decoy") & (F.col("best_channel_qvalue") < config.q_threshold))
    atoms = F.coalesce(composition(untagged(F.col("mod_seq"), config.tag or "mTRAQ")), composition(stripped(F.col("mod_seq"))))
    best = patterns(wanted.select("run", "prec_id", "scan_num", "prec_mz", "charge", atoms.alias("_atoms")), "_atoms", config.isotopes).drop("_atoms")
    coefficients = None if psm is None else psm.join(scans.select("scan_num", "run"), "scan_num").select("run", "prec_id", "rt", "coeff").join(wanted.select("run", "prec_id"), ["run", "prec_id"], "left_semi")
    areas = quant.survey_areas(best, scans, config.ms1_tol, n=config.isotopes, axis="scan_in_run", coefficients=coefficients)
    out = ids.join(areas, ["run", "prec_id"], "left").fillna(0.0, [c for c in QUANTITIES if c in areas.columns])
    if not config.tag:
        return out
    amounts = channel_amounts(stored(wanted.select("run", "untag_prec", "scan_num", "mod_seq", "charge", "prec_mz", "coeff"), "wanted"), scans, config)
    return out.join(amounts, ["run", "untag_prec", "channel"], "left").fillna(0.0, ["plex_fit", "plex_area"])


def run(spark: SparkSession, mzml: str, library: str, out: str, config: s.Config = s.Config()) -> DataFrame:
    """The whole analysis of one or many mzML files against a library; returns all identified rows, decoys included.

    Under `out`: scans and library (caches, read again by a later run), first_search, calibration, psm (result rows), all_ids, filtered_ids, narrow,
    summary and params. Files are overwritten, so a run that is repeated after a failure doubles nothing.
    """
    scans = with_scan_ids(readers.read_scans(spark, mzml, f"{out}/scans"))
    targets = readers.read_any_library(spark, library, f"{out}/library")
    targets = tagged_library(targets, config.tag) if config.tag else targets
    precursors = stored(with_ids(s.add_decoys(targets, config.decoys, config.tag or "mTRAQ")), "precursors")
    fragments = stored(readers.library_fragments(precursors), "fragments")
    found, calibration = first_search(scans, fragments, precursors, config)
    writers.write_first_search(found, f"{out}/first_search")
    writers.write_calibration(spark, calibration, f"{out}/calibration")
    predictor = None
    if config.predict_rt:
        known = found.join(precursors.select("prec_id", "mod_seq"), "prec_id").select(stripped(F.col("mod_seq")).alias("seq"), "irt", "rt")
        predictor = chosen(stored(known, "known"), calibration.predicted_rt(F.col("irt")), "seq", "rt", least=config.predict_least)
    moved, scans, narrow = calibrated(precursors, scans, calibration, config, predictor)
    psm = stored(s.search(scans.where("ms_level = 2"), fragments, moved, narrow, scans if config.ms1_required else None), "psm")
    ids = quantified(identified(psm, scans, precursors, config), scans, narrow, psm)
    shown = calibration.corrected_mz(F.col("prec_mz"), F.col("rt"))  # where the run's survey scans show the precursor
    table = stored(ids.withColumns({"decoy": F.col("is_decoy"), "z": F.col("charge"), "file_name": F.col("run")}), "ids")
    writers.write_result_rows(table.withColumns({"spec_id": F.col("scan_in_run"), "window_mz": F.col("prec_mz"), "mz": shown, "seq": F.col("mod_seq")}), f"{out}/psm")
    writers.write_results(table, out, config.q_threshold)
    writers.write_summary(table, f"{out}/summary", config.q_threshold)
    writers.write_params(spark, asdict(config), f"{out}/params")
    return table
