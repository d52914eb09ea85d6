"""Quantities on the survey scans: nearest peaks, traces, picked peaks, channels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .joins import nearest, nearest_match, range_join
from .solve import nnls
from .traces import pearson, pearson_p


def nearest_survey(scans: DataFrame) -> DataFrame:
    """Each fragment scan with the RT of the nearest survey scan of its run; the earlier of equally near ones."""
    ms1 = scans.where("ms_level = 1").select("run", "rt")
    return nearest(scans.where("ms_level = 2"), ms1, "rt", ["run"], "ms1_rt", later_on_tie=False)


def survey_errors(cands: DataFrame, scans: DataFrame, rel: float) -> DataFrame:
    """(scan_num, prec_id, mz_error): for each candidate the signed relative error of the survey peak nearest its m/z, within the tolerance, in the
    survey scan nearest its fragment scan. Candidates without such a peak have no row. cands: scan_num, prec_id, prec_mz; scans: run, scan_num, ms_level, rt, mz[], intensity[]."""
    near = nearest_survey(scans.select("run", "scan_num", "ms_level", "rt")).select("run", "scan_num", F.col("ms1_rt"))
    ms1 = scans.where("ms_level = 1").select("run", F.col("rt").alias("ms1_rt"), F.explode("mz").alias("peak"))
    at = cands.join(near, "scan_num").select("scan_num", "prec_id", "prec_mz", "run", "ms1_rt")
    once = at.select("run", "ms1_rt", "prec_id", "prec_mz").distinct()  # several fragment scans share a survey scan
    hit = nearest_match(once, ["run", "ms1_rt", "prec_id"], "prec_mz", ms1, "peak", rel, ["run", "ms1_rt"], [])
    return at.join(hit, ["run", "ms1_rt", "prec_id"]).select("scan_num", "prec_id", F.col("rel_error").alias("mz_error"))


def survey_areas(best: DataFrame, scans: DataFrame, rel: float, half: int = 10, n: int = 6, axis: str = "scan_num", coefficients: DataFrame | None = None) -> DataFrame:
    """Quantities of precursors from the survey scans within `half` of the one nearest each one's best fragment scan, per (run, prec_id):

    ms1_area, the trapezoid area of the monoisotopic trace over the scans' numbers (the column `axis`); ms1_int, the slope through the origin of the isotopes seen in the nearest survey
    scan on the theoretical ones, and iso_cor, Pearson's r of the two; peak_left, peak_right, peak_area, the bases and area (over time) of the trace's peak nearest that scan; with
    coefficients (run, prec_id, rt, coeff of all matches), ms1_cor, the correlation of the monoisotopic trace with the coefficients (0 in a possible fragment scan
    without a match) interpolated at the survey scans' times, and traceproduct of it and of the next two isotopes'.
    best: run, prec_id, scan_num, prec_mz, charge, isotopes (theoretical shares); scans: run, scan_num, ms_level, rt, mz[], intensity[] and the axis.
    """
    from .traces import interpolate, isotope_fit, trace_product, trapezoid

    key = ["run", "prec_id"]
    ms1 = scans.where("ms_level = 1").withColumn("peaks", F.arrays_zip("mz", "intensity")).drop("mz", "intensity")
    near = nearest_survey(scans.select("run", "scan_num", "ms_level", "rt")).select("run", "scan_num", F.col("ms1_rt").alias("rt"))
    apex = stored(best.join(near, ["run", "scan_num"]).join(ms1.select("run", "rt", F.col("scan_num").alias("ms1_scan")), ["run", "rt"]), "apex")
    hood = survey_neighbourhood(apex.select(*key, "ms1_scan", F.col("prec_mz").alias("mz"), F.col("charge").alias("z")), ms1, half)
    traces = stored(isotope_traces(hood, rel, n), "traces")
    mono = traces.where("iso = 0").drop("iso").join(ms1.select("run", "scan_num", *([F.col(axis).alias("_axis")] if axis != "scan_num" else [])), ["run", "scan_num"])
    out = trapezoid(mono, key, "_axis" if axis != "scan_num" else "scan_num", "intensity", "ms1_area")
    theory = apex.select(*key, F.col("ms1_scan").alias("scan_num"), F.posexplode("isotopes").alias("iso", "theory"))
    fit = isotope_fit(traces.join(theory, [*key, "scan_num", "iso"]), key, "theory", "intensity").select(*key, F.col("slope").alias("ms1_int"), F.col("r").alias("iso_cor"))
    peak = picked(mono.select(*key, "ms1_rt", "intensity").join(apex.select(*key, F.col("rt").alias("apex")), key), key, "ms1_rt", "intensity", "apex")
    out = out.join(fit, key, "left").join(peak.select(*key, F.col("left").alias("peak_left"), F.col("right").alias("peak_right"), F.col("area").alias("peak_area")), key, "left")
    if coefficients is None:
        return out
    span = traces.groupBy(*key).agg(F.min("ms1_rt").alias("_from"), F.max("ms1_rt").alias("_to")).join(best.select(*key, "prec_mz"), key)
    knots = possible_scans(span, scans).join(coefficients.select(*key, "rt", "coeff"), [*key, "rt"], "left").select(*key, F.col("rt").alias("ms1_rt"), F.coalesce("coeff", F.lit(0.0)).alias("coeff"))
    seen = interpolate(mono.select(*key, "scan_num", "ms1_rt"), knots, key, "ms1_rt", "coeff", "intensity").drop("ms1_rt")
    cors = trace_correlations(traces.where("iso < 3"), seen, key, "scan_num", "intensity").groupBy(*key).agg(*[F.max(F.when(F.col("iso") == i, F.col("r"))).alias(f"_c{i}") for i in range(3)])
    return out.join(cors.select(*key, F.col("_c0").alias("ms1_cor"), trace_product("_c0", "_c1", "_c2").alias("traceproduct")), key, "left")


def possible_scans(precursors: DataFrame, scans: DataFrame, width: float = 10.0) -> DataFrame:
    """(run, prec_id, rt): the fragment scans whose window holds a precursor's m/z, from its time _from to _to."""
    ms2 = scans.where("ms_level = 2").select("run", "rt", "win_lo", "win_hi")
    return range_join(precursors, "prec_mz", ms2, "win_lo", "win_hi", width, ["run"], open_lo=False).where("rt between _from and _to").select("run", "prec_id", "rt")


def nearest_peak(mz: Column, peaks: Column, tol: Column, inclusive: bool = True) -> Column:
    """The peak (struct with mz, intensity) nearest to mz in an array sorted by m/z, within tol; a tie goes right; null if none."""
    near = F.filter(peaks, lambda p: (F.abs(p["mz"] - mz) <= tol) if inclusive else (F.abs(p["mz"] - mz) < tol))
    return F.array_max(F.transform(near, lambda p: F.struct((-F.abs(p["mz"] - mz)).alias("near"), p["mz"].alias("mz"), p["intensity"].alias("intensity"))))


def survey_neighbourhood(apexes: DataFrame, scans: DataFrame, half: int = 10) -> DataFrame:
    """Survey scans within `half` positions of a precursor's apex scan: apexes has run, prec_id and ms1_scan."""
    order = scans.where("ms_level = 1").withColumn("pos", F.row_number().over(Window.partitionBy("run").orderBy("rt", "scan_num")))
    at = apexes.join(order.select("run", F.col("scan_num").alias("ms1_scan"), F.col("pos").alias("apex_pos")), ["run", "ms1_scan"])
    wide = at.withColumn("pos", F.explode(F.sequence(F.col("apex_pos") - half, F.col("apex_pos") + half)))
    return wide.join(order.select("run", "pos", "scan_num", F.col("rt").alias("ms1_rt"), "peaks"), ["run", "pos"])


def isotope_traces(hood: DataFrame, rel: float, n: int = 6) -> DataFrame:
    """Long rows (run, prec_id, scan_num, ms1_rt, iso, intensity); 0 where no peak is near."""
    from ..functions.isotopes import precursor_isotopes

    rows = hood.select("run", "prec_id", "scan_num", "ms1_rt", "peaks", F.posexplode(precursor_isotopes(F.col("mz"), F.col("z"), n)).alias("iso", "at"))
    hit = nearest_peak(F.col("at"), F.col("peaks"), F.col("at") * rel)
    return rows.select("run", "prec_id", "scan_num", "ms1_rt", "iso", F.coalesce(hit["intensity"], F.lit(0.0)).alias("intensity"))


def pick_peak(values: np.ndarray, apex: int) -> tuple[int, int, int]:
    """(left, top, right) of the local maximum nearest to apex with the bases of its prominence; without one,
    the largest value and the whole range. A plateau counts at its middle."""
    n, tops, i = len(values), [], 1
    while i < n - 1:
        if values[i - 1] < values[i]:
            j = i
            while j < n - 1 and values[j + 1] == values[i]:
                j += 1
            if j < n - 1 and values[j + 1] < values[i]:
                tops.append((i + j) // 2)
            i = j
        i += 1
    if not tops:
        return 0, int(values.argmax()) if n else 0, n - 1
    top = min(tops, key=lambda t: (abs(t - apex), t))

    def base(step: int) -> int:
        at = best = top
        while 0 <= at < n and values[at] <= values[top]:
            if values[at] < values[best]:
                best = at
            at += step
        return best

    return base(-1), top, base(1)


def picked(traces: DataFrame, on: list[str], x: str, y: str, apex: str) -> DataFrame:
    """(key, left, top, right, area) of each trace's picked peak; apex is the column with the expected x."""
    keys = ", ".join(f"`{c}` {dict(traces.dtypes)[c]}" for c in on)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(x)
        xs, ys = part[x].to_numpy(float), part[y].to_numpy(float)
        lo, top, hi = pick_peak(ys, int(np.abs(xs - part[apex].iloc[0]).argmin()))
        area = float(np.trapezoid(ys[lo : hi + 1], xs[lo : hi + 1]))
        return pd.DataFrame([[*part[on].iloc[0], xs[lo], xs[top], xs[hi], area]], columns=[*on, "left", "top", "right", "area"])

    return traces.groupBy(*on).applyInPandas(run, f"{keys}, left double, top double, right double, area double")


def trace_correlations(traces: DataFrame, reference: DataFrame, on: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(key, iso, r, n, p): Pearson's r of each isotope's trace with a reference trace, null below `least` points, and its p-value."""
    both = traces.join(reference.select(*on, x, F.col(y).cast("double").alias("_ref")), [*on, x]).where(f"{y} is not null and _ref is not null and not isnan({y}) and not isnan(_ref)")
    got = both.groupBy(*on, "iso").agg(pearson(y, "_ref").alias("r"), F.count("*").alias("n"))
    got = got.withColumn("r", F.when((F.col("n") >= least) & ~F.isnan("r"), F.col("r")))
    return got.withColumn("p", pearson_p(F.col("r"), F.col("n")))


def fit_channels(mz: np.ndarray, intensity: np.ndarray, at: list[np.ndarray], share: list[np.ndarray], rel: float) -> np.ndarray:
    """One amount a channel from the survey peaks around its isotopes (at, with their shares of the whole).

    Peaks within the tolerance of a peak below them are one. Every peak that an isotope falls on, within the tolerance, is an equation, over all channels' isotopes there;
    the shares of a channel's isotopes that fall on none are one more, with nothing observed.
    """
    order = np.argsort(mz, kind="stable")
    mz, intensity = mz[order], intensity[order]
    anchor = np.searchsorted(mz * (1 + rel), mz)
    heads, group = np.unique(anchor, return_inverse=True)
    centre, total = mz[heads], np.bincount(group, intensity, len(heads)) if len(mz) else np.zeros(0)
    a, missed = np.zeros((len(centre), len(at))), np.zeros(len(at))
    for c, (places, shares) in enumerate(zip(at, share, strict=True)):
        for x, v in zip(places, shares, strict=True):
            i = int(np.searchsorted(centre, x))
            near = min((j for j in (i - 1, i) if 0 <= j < len(centre)), key=lambda j: abs(centre[j] - x), default=-1)  # noqa: B023
            if near >= 0 and abs(centre[near] - x) <= rel * centre[near]:
                a[near, c] += v
            else:
                missed[c] += v
    used = a.any(1)
    if not used.any():
        return np.zeros(len(at))
    return nnls(np.vstack([a[used], np.diag(missed)]), np.append(total[used], np.zeros(len(at))))


def channel_traces(groups: DataFrame, scans: DataFrame, rel: float, half: int = 10) -> DataFrame:
    """(run, group, channel, scan_num, ms1_rt, amount): each channel's amount in the survey scans within `half` of a group's, by fit_channels over all of the group's
    channels together. groups: run, group (long), ms1_scan, members array of (channel, mz, z, isotopes); scans: run, scan_num, ms_level, rt, mz[], intensity[].

    A row holds one group in one scan with the peaks around its isotopes, so nothing is grouped or shuffled for the fit.
    """
    from ..functions.constants import ISOTOPE_STEP

    ms1 = scans.where("ms_level = 1").withColumn("peaks", F.arrays_zip("mz", "intensity")).drop("mz", "intensity")
    hood = survey_neighbourhood(groups.select("run", F.col("group").alias("prec_id"), "ms1_scan", "members"), ms1, half)
    lo = F.array_min(F.transform("members", lambda m: m["mz"])) - 1
    hi = F.array_max(F.transform("members", lambda m: m["mz"] + (F.size(m["isotopes"]) - 1) * F.lit(ISOTOPE_STEP) / m["z"])) + 1
    rows = hood.withColumns({"_lo": lo, "_hi": hi}).withColumn("_near", F.filter("peaks", lambda p: (p["mz"] > F.col("_lo")) & (p["mz"] < F.col("_hi"))))

    def fit(mz: pd.Series, intensity: pd.Series, first: pd.Series, charge: pd.Series, isotopes: pd.Series) -> pd.Series:
        out = []
        for m, i, f, z, s in zip(mz, intensity, first, charge, isotopes, strict=True):
            shares = [np.asarray(x, float) for x in s]
            places = [x + np.arange(len(v)) * ISOTOPE_STEP / c for x, c, v in zip(f, z, shares, strict=True)]
            out.append(fit_channels(np.asarray(m, float), np.asarray(i, float), places, shares, rel).tolist())
        return pd.Series(out)

    amounts = F.pandas_udf(fit, "array<double>")("_near.mz", "_near.intensity", "members.mz", "members.z", "members.isotopes")
    rows = rows.withColumn("_fit", F.arrays_zip(F.col("members.channel").alias("channel"), amounts.alias("amount")))
    return rows.select("run", F.col("prec_id").alias("group"), "scan_num", "ms1_rt", F.explode("_fit").alias("f")).select("run", "group", "f.channel", "scan_num", "ms1_rt", "f.amount")
