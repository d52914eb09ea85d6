"""Channels of a mass tag: a library for all of them, and amounts unmixed from overlapping isotopes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.functions.constants import ISOTOPE_STEP, MASS_TAGS
from ionframe.functions.isotopes import pattern
from ionframe.functions.peptide import peptide_mz
from ionframe.operators import quant
from ionframe.plans import run, search


def test_fit_by_hand():
    share = [np.array([0.5, 0.3]), np.array([0.6, 0.2])]
    at = [np.array([500.0, 501.0]), np.array([501.0, 502.0])]  # one peak of each on 501
    amounts = quant.fit_channels(np.array([500.0, 501.0, 501.002, 502.0]), np.array([50.0, 50.0, 70.0, 30.0]), at, share, 10e-6)  # two near peaks are one
    assert amounts == pytest.approx([100, 150])
    assert quant.fit_channels(np.array([500.0, 501.0, 502.0]), np.array([50.0, 30 + 120, 40]), at, share, 10e-6) == pytest.approx([100, 200])
    lone = quant.fit_channels(np.array([500.0]), np.array([50.0]), at, share, 10e-6)  # three isotopes without a peak hold both down
    assert lone[1] == 0 and lone[0] == pytest.approx(50 * 0.5 / (0.5**2 + 0.3**2))
    assert quant.fit_channels(np.zeros(0), np.zeros(0), at, share, 1e-5).tolist() == [0, 0]


@pytest.fixture(scope="module")
def plex(spark):
    """Twelve peptides in three channels whose isotopes overlap, in 21 survey scans with noise."""
    r = np.random.default_rng(5)
    shifts = MASS_TAGS["mTRAQ"][2]
    seqs = ["".join(r.choice(list("ADEFGHILNPQSTVWY"), 9)) + "R" for _ in range(12)]
    base = {x.s: (x.mz, tuple(x.c)) for x in spark.createDataFrame([(s,) for s in seqs], "s string").select("s", peptide_mz(F.concat(F.lit(""), "s"), F.lit(3)).alias("mz"), run.composition(F.col("s")).alias("c")).collect()}
    amounts, scans = {}, []
    for n in range(21):
        peaks = [(float(x), float(y)) for x, y in zip(r.uniform(400, 900, 200), r.uniform(1, 5, 200))]
        for s in seqs:
            mz, atoms = base[s]
            for k, (c, shift) in enumerate(shifts.items()):
                total = amounts.setdefault((s, c), float(10 ** r.uniform(4, 5)))
                for i, v in enumerate(pattern(atoms, 6)):
                    peaks.append((mz + (140.0949630177 + shift) / 3 + i * ISOTOPE_STEP / 3, float(total * v * np.exp(-((n - 10) ** 2) / 18))))
        peaks.sort()
        scans.append(("one", 2 * n, 1, n / 10, [m for m, _ in peaks], [i for _, i in peaks]))
        scans.append(("one", 2 * n + 1, 2, n / 10 + 0.01, [], []))
    return amounts, spark.createDataFrame(scans, "run string, scan_num long, ms_level int, rt double, mz array<double>, intensity array<double>"), base


def test_planted_ratios_come_back(spark, plex):
    amounts, scans, base = plex
    mark = "(mTRAQ-4)"
    rows = [("one", f"{s}_3", 21, s[0] + mark + s[1:], 3, base[s][0] + (140.0949630177 + MASS_TAGS["mTRAQ"][2]["4"]) / 3, 100.0) for s in base]
    rows += [("one", f"{s}_3", 5, s[0] + mark + s[1:], 3, 1.0, 1.0) for s in base]  # lesser matches of the same precursors don't count
    ids = spark.createDataFrame(rows, "run string, untag_prec string, scan_num long, mod_seq string, charge int, prec_mz double, coeff double")
    got = run.channel_amounts(ids, scans, search.Config(tag="mTRAQ", ms1_tol=10e-6)).collect()
    assert len(got) == len(amounts)
    for x in got:
        want = amounts[x.untag_prec[:-2], x.channel]
        assert x.plex_fit == pytest.approx(want, rel=0.05) and 2 * want < x.plex_area <= 3 * want * 1.05


def test_library_of_all_channels(spark):
    frags = F.array(F.struct(F.lit(300.0).alias("mz"), F.lit(1.0).alias("intensity"), F.lit("b2_1").alias("name")), F.struct(F.lit(200.0).alias("mz"), F.lit(2.0).alias("intensity"), F.lit("y1_1").alias("name")))
    lib = spark.createDataFrame([("ACDK", "ACDK", 2, 400.0, 1.0)], "mod_seq string, seq string, charge int, prec_mz double, irt double").withColumns({"frags": frags, "is_decoy": F.lit(False)})
    got = run.tagged_library(lib, "mTRAQ")
    rows = {x.mod_seq: x for x in got.collect()}
    assert set(rows) == {f"A(mTRAQ-{c})CDK(mTRAQ-{c})" for c in "048"} and got.columns == lib.columns
    one = rows["A(mTRAQ-4)CDK(mTRAQ-4)"]
    mass = 140.0949630177 + 4.0070994
    assert one.prec_mz == pytest.approx(400 + mass) and [f.mz for f in one.frags] == pytest.approx([200 + mass, 300 + mass]) and one.irt == 1.0
    assert run.tagged_library(got, "mTRAQ").count() == 3
