"""The whole analysis through files: a synthetic mzML run and a library table."""

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.functions import peptide
from ionframe.operators import calibrate, quant, spectra
from ionframe.plans import run, search
from ionframe.sources import readers, writers

import synth


def binary(values, accession, kind="MS:1000523", zipped=True):
    raw = np.asarray(values, "<f8" if kind == "MS:1000523" else "<f4").tobytes()
    data = base64.b64encode(zlib.compress(raw) if zipped else raw).decode()
    marks = "".join(f'<cvParam accession="{a}" value=""/>' for a in (accession, kind, *(["MS:1000574"] if zipped else [])))
    return f"<binaryDataArray>{marks}<binary>{data}</binary></binaryDataArray>"


def mzml(scans) -> str:
    out = ['<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>']
    for n, (_, number, level, rt, tic, target, lo, hi, mz, intensity) in enumerate(scans):
        own = f'<cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000285" value="{tic!r}"/>'
        time = f'<scanList><scan><cvParam accession="MS:1000016" value="{rt!r}" unitAccession="UO:0000031"/></scan></scanList>'
        window = "" if level == 1 else "<precursorList><precursor><isolationWindow>" + "".join(f'<cvParam accession="{a}" value="{v!r}"/>' for a, v in (("MS:1000827", target), ("MS:1000828", target - lo), ("MS:1000829", hi - target))) + "</isolationWindow></precursor></precursorList>"
        out.append(f'<spectrum id="controllerType=0 scan={number}" index="{n}">{own}{time}{window}<binaryDataArrayList>{binary(mz, "MS:1000514", zipped=n % 2 == 0)}{binary(intensity, "MS:1000515", "MS:1000521" if n % 3 == 0 else "MS:1000523")}</binaryDataArrayList></spectrum>')
    return "".join([*out, "</spectrumList></run></mzML>"])


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("run")
    library, scans, truth = synth.run(peptides=40, cycles=30, windows=4)
    (at / "one.mzML").write_text(mzml(scans))
    head = "ModifiedPeptide StrippedPeptide PrecursorCharge PrecursorMz Tr_recalibrated FragmentType FragmentNumber FragmentCharge FragmentLossType FragmentMz RelativeIntensity ProteinGroup".split()
    lines = ["\t".join(head)]
    for n, (seq, z, mz, irt, frags) in enumerate(library):
        for m, i, name in frags:
            lines.append("\t".join(map(str, (f"_{seq}_", seq, z, mz, irt * 3 - 5, name[0], name[1:].split("_")[0], 1, "noloss", m, i, f"P{n % 10}"))))
    (at / "library.tsv").write_text("\n".join(lines))
    config = search.Config(rt_tol=60.0, trees=20, depth=5, folds=3, q_threshold=0.2)
    table = run.run(spark, f"file://{at}/one.mzML", f"file://{at}/library.tsv", f"file://{at}/out", config)
    return at, table.toPandas(), library, scans, truth


def test_scans_come_back(spark, done):
    at, _, _, scans, _ = done
    got = {r.scan_num: r for r in readers.read_scans(spark, "nowhere", f"file://{at}/out/scans").collect()}
    assert len(got) == len(scans)
    for _, number, level, rt, _, target, lo, hi, mz, intensity in scans:
        r = got[number]
        assert r.ms_level == level and r.rt == pytest.approx(rt) and r.mz == pytest.approx(mz) and r.intensity == pytest.approx(intensity, rel=1e-6)
        if level == 2:
            assert (r.prec_mz, r.win_lo, r.win_hi) == pytest.approx((target, lo, hi))


def test_peptides_are_identified_at_their_times(done):
    _, table, library, _, _ = done
    found = table[~table.is_decoy & (table.best_channel_qvalue < 0.2)]
    times = {seq: irt for seq, _, _, irt, _ in library}
    assert len(found) >= 0.8 * len(library)
    assert np.median(np.abs(found.rt - found.stripped_seq.map(times))) < 1
    assert (table[table.is_decoy].coeff.sum() if table.is_decoy.any() else 0) < 0.1 * table[~table.is_decoy].coeff.sum()
    assert found.mz_error.abs().max() < 20e-6 and found.protein_qvalue.notna().all()


def test_quantities_follow_amounts(done):
    _, table, library, scans, _ = done
    amount = {}
    for seq, _, mz, _, _ in library:
        near = [(abs(m - mz) / mz, i) for s in scans if s[2] == 1 for m, i in zip(s[8], s[9])]
        amount[seq] = max((i for d, i in near if d < 12e-6), default=0)
    own = table[table.ms1_area > 0]
    assert len(own) > 20 and own.traceproduct.median() > -0.5 and own.ms1_cor.median() > 0.8
    assert (own.peak_left <= own.rt + 1).all() and (own.peak_right >= own.rt - 1).all()
    assert np.corrcoef(np.log(own.ms1_int), np.log(own.stripped_seq.map(amount)))[0, 1] > 0.95


def analysed(spark, library, scans, **config):
    """first search, calibration and search of a run that isn't on disk: (calibration, tolerances, targets found, best matches)."""
    frame = run.with_scan_ids(spark.createDataFrame(scans, synth.SCANS))
    targets = spark.createDataFrame(library, synth.LIBRARY).withColumns({"seq": F.col("mod_seq"), "is_decoy": F.lit(False), "irt": F.col("irt") * 1.3 + 2})
    precursors = search.stored(run.with_ids(search.add_decoys(targets)), "precursors")
    fragments = readers.library_fragments(precursors)
    config = search.Config(rt_tol=60.0, **config)
    _, calibration = run.first_search(frame, fragments, precursors, config)
    moved, peaks, narrow = run.calibrated(precursors, frame, calibration, config)
    psm = search.search(peaks.where("ms_level = 2"), fragments, moved, narrow, peaks).toPandas()
    best = psm[~psm.is_decoy].sort_values("coeff").groupby("prec_id").tail(1)
    return calibration, narrow, len(best), best


@pytest.mark.parametrize("shift, drift", [(7, 0), (-6, 6)])
def test_mass_errors_are_corrected(spark, shift, drift):
    library, scans, _ = synth.run(peptides=40, cycles=30, windows=4, shift=shift, drift=drift)
    calibration, narrow, found, best = analysed(spark, library, scans)
    assert found >= 38, found  # without a mass error 38 to 40
    for curve, near in ((calibration.mz_by_rt, 5), (calibration.frag_by_rt, 1)):  # one noisy survey peak a match, and many fragments
        at = np.interp([3, 10, 17], *map(np.array, curve)) * 1e6
        assert np.abs(at - (shift + drift * (np.array([3, 10, 17]) / 20 - 0.5))).max() < near, at
    assert 1e-6 <= narrow.mz_tol < 9e-6 and narrow.ms1_tol <= 20e-6
    errors = np.concatenate(best.frag_errors.to_list())
    assert abs(np.median(errors)) < 0.5e-6 and abs(best.mz_error.median()) < 1.5e-6


def test_a_run_without_matches_says_so(spark):
    library, scans, _ = synth.run(peptides=4, cycles=4, windows=2)
    with pytest.raises(ValueError, match="nothing to calibrate on"):
        analysed(spark, library, [s for s in scans if s[2] == 1] + [(*s[:8], [100.0], [1.0]) for s in scans if s[2] == 2])


def test_outputs_and_caches(spark, done):
    at, table, _, _, _ = done
    out = f"file://{at}/out"
    assert spark.read.parquet(f"{out}/all_ids").count() == len(table)
    assert spark.read.parquet(f"{out}/filtered_ids").where("decoy").count() == 0
    rows = readers.read_results(spark, f"{out}/psm").collect()
    assert len(rows) == len(table) and all(len(r.frag_names) == len(r.obs_int) == len(r.frag_mz) for r in rows)
    kept = writers.read_calibration(spark, f"{out}/calibration")
    assert isinstance(kept, calibrate.Calibration) and kept.rt_tol > 0 and calibrate.Calibration.of_json(kept.as_json()) == kept
    irt = spark.createDataFrame([(10.0 * 3 - 5,)], "x double").select(kept.predicted_rt(F.col("x"))).head()[0]
    assert irt == pytest.approx(10, abs=1)
    assert "precursors" in spark.read.text(f"{out}/summary").head()[0]
    assert '"mz_tol"' in spark.read.text(f"{out}/params").head()[0]
    assert readers.read_any_library(spark, "nowhere", f"{out}/library").count() == 40


def test_decoys_match_their_peptides(spark):
    frags = F.array(F.struct(F.lit(1.0).alias("mz"), F.lit(1.0).alias("intensity"), F.lit("b2_1").alias("name")))
    lib = spark.createDataFrame([("A(mTRAQ-0)C(UniMod:4)DEK(mTRAQ-0)", "ACDEK", 2, 300.0)], "mod_seq string, seq string, charge int, prec_mz double").withColumns({"frags": frags, "is_decoy": F.lit(False)})
    rev = search.add_decoys(lib).where("is_decoy").head()
    assert rev.mod_seq == "E(mTRAQ-0)DC(UniMod:4)AK(mTRAQ-0)" and rev.seq == "EDCAK"
    sub = search.add_decoys(lib, "substitute").where("is_decoy").head()
    assert sub.mod_seq == "L(mTRAQ-0)S(UniMod:4)EDL(mTRAQ-0)" and sub.seq == "LSEDL"
    mass = lib.select(peptide.token_mass(F.lit("C(Unknown:1)")), peptide.composition(F.lit("PEP(Unknown:1)K")), peptide.composition(F.lit("GG")))
    assert mass.head()[0] is None and mass.head()[1] is None and tuple(mass.head()[2]) == (4, 8, 2, 3, 0)


def test_sample_is_the_same_in_any_partitioning(spark):
    df = spark.range(1000)
    a = {r.id for r in spectra.seeded_sample(df, 50, ["id"]).collect()}
    assert len(a) == 50 and a == {r.id for r in spectra.seeded_sample(df.repartition(7), 50, ["id"]).collect()}
    assert spectra.seeded_sample(df, 5000, ["id"]).count() == 1000


def test_step_spline_leaves_outliers_out():
    x = np.linspace(0, 10, 300)
    y = np.abs(x - 5)
    y[::20] += 30
    at, values = calibrate.step_spline(x, y, steps=3, knots=11)
    assert np.abs(np.interp(x, at, values) - np.abs(x - 5)).max() < 0.5
    assert calibrate.step_spline([1, 1, 2], [1, 3, 5])[1].tolist() == [2, 5]


def test_constant_traces_have_no_correlation(spark):
    rows = spark.createDataFrame([(1, 1, float(i), 3.0) for i in range(5)], "k int, iso int, x double, y double")
    got = quant.trace_correlations(rows, rows.drop("iso").withColumn("y", F.col("x")), ["k"], "x", "y").head()
    assert got.r is None and got.n == 5
