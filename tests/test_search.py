"""End to end on a synthetic run: true abundances come back, decoys don't."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.plans import search as s
from ionframe.sources.readers import library_fragments

import synth


@pytest.fixture(scope="module")
def found(spark):
    lib, scans, truth = synth.run(peptides=30, cycles=24, windows=4)
    library = spark.createDataFrame(lib, synth.LIBRARY).withColumn("seq", F.col("mod_seq")).withColumn("is_decoy", F.lit(False))
    both = s.add_decoys(library).withColumn("prec_id", F.xxhash64("mod_seq", "charge", "is_decoy"))
    names = {r["mod_seq"]: r["prec_id"] for r in both.where("not is_decoy").collect()}
    ms2 = spark.createDataFrame(scans, synth.SCANS).where("ms_level = 2")
    psm = s.search(ms2, library_fragments(both), both, s.Config(rt_tol=3.0)).toPandas()
    return psm, {(names[lib[k][0]], n): level for k, n, level in truth}


def test_abundances_come_back(found):
    psm, truth = found
    hits = [(c, truth[k]) for k, c in zip(zip(psm.prec_id, psm.scan_num, strict=True), psm.coeff, strict=True) if k in truth]
    assert len(hits) >= 0.9 * len(truth)
    ratio = np.array([a / b for a, b in hits])
    assert 0.85 < np.median(ratio) < 1.15


def test_decoys_are_rare(found):
    psm, _ = found
    assert psm.is_decoy.mean() < 0.05
    assert psm.rt_error.abs().max() < 3.0
