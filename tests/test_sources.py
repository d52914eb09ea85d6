"""mzML files split where spectra end, against a plain XML reader."""

import pytest
from pyspark.sql import functions as F

import mzml_reference
import synth
from ionframe.sources import readers
from test_run import mzml


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    _, scans, _ = synth.run(peptides=12, cycles=12, windows=3)
    scans[5] = (*scans[5][:8], [], [])  # an empty spectrum
    at = tmp_path_factory.mktemp("mzml") / "a run.raw.mzML"
    text = mzml(scans)
    odd = """<spectrum id="spectrum=77" index="900"><cvParam accession="MS:1000511" value="2"/><scanList><scan><cvParam value="90" accession="MS:1000016" unitAccession="UO:0000010"/><cvParam accession="MS:1000927" value="25.5"/>
      </scan></scanList><precursorList><precursor><isolationWindow><cvParam accession="MS:1000827" value="500.5"/></isolationWindow></precursor></precursorList><binaryDataArrayList><binaryDataArray><cvParam accession="MS:1000514"/><binary/></binaryDataArray></binaryDataArrayList></spectrum>
      <spectrum id="scan=99999" index="901"><cvParam accession="MS:1000511" value="3"/></spectrum>"""
    at.write_text(text.replace("</spectrumList>", f"{odd}</spectrumList><chromatogramList>nothing</chromatogramList>"))
    return at


def test_one_file_in_many_tasks_equals_the_plain_reader(spark, file):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = readers.read_mzml(spark, f"file://{file}")
        assert df.rdd.getNumPartitions() > 5
        names = [c.split(" ")[0] for c in readers.SCANS.split(", ")]
        assert df.columns == names and df.dtypes == spark.createDataFrame([], readers.SCANS).dtypes
        got = sorted(tuple(r) for r in df.collect())
        want = sorted(mzml_reference.scans(file.read_text(), "a%20run" if "%20" in got[0][0] else "a run"))
        assert len(got) == len(want) == 12 * 4 + 1
        for a, b in zip(got, want, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == (pytest.approx(y, rel=1e-12) if isinstance(y, (float, list)) else y), (a[1], x, y)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_spectrum_library_with_decoys(spark, tmp_path):
    import sqlite3
    import zlib

    import numpy as np

    from ionframe.functions import peptide
    from ionframe.plans import search

    seq = "AC[+57.02146]DEK"
    df = spark.createDataFrame([(seq,)], "s string").withColumn("t", peptide.residues(F.col("s")))
    mz = lambda k, i: df.select(peptide.fragment_mz(F.col("t"), F.lit(k), F.lit(i), F.lit(1), F.lit(None).cast("string"))).head()[0]
    peaks = sorted([(mz("b", 2), 10.0), (mz("y", 1), 30.0), (mz("y", 3) * (1 + 5e-6), 20.0), (333.33, 99.0)])
    with sqlite3.connect(tmp_path / "x.blib") as db:
        db.execute("create table RefSpectra (id int, peptideModSeq text, precursorCharge int, precursorMZ real, retentionTime real, numPeaks int)")
        db.execute("create table RefSpectraPeaks (RefSpectraID int, peakMZ blob, peakIntensity blob)")
        a, b = np.array([p[0] for p in peaks], "<f8").tobytes(), np.array([p[1] for p in peaks], "<f4").tobytes()
        db.execute("insert into RefSpectra values (1, ?, 2, 300.5, 12.5, 4), (2, 'A[+5]X', 2, 1, 1, 4)", (seq,))
        db.executemany("insert into RefSpectraPeaks values (?, ?, ?)", [(1, zlib.compress(a), b), (2, a, b)])
    library = readers.read_any_library(spark, f"file://{tmp_path}/x.blib")
    row = library.collect()
    assert len(row) == 1 and [f.name for f in row[0].frags] == [n for _, n in sorted([(mz("b", 2), "b2_1"), (mz("y", 1), "y1_1"), (mz("y", 3), "y3_1")])]
    both = search.add_decoys(library).orderBy("is_decoy").collect()
    assert both[1].mod_seq == "EDC[+57.02146]AK" and len(both[1].frags) == 3 and both[1].frags != both[0].frags


def test_filters_come_before_decoding(spark, file):
    df = readers.read_mzml(spark, f"file://{file}")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan(df.select("scan_num", "ms_level", "rt"))
    assert df.where("ms_level = 1").count() == 12
    text = plan(df.where("ms_level = 1").select("mz"))
    assert text.index("ArrowEvalPython") < text.rindex("Filter") and df.where("scan_num = 901").select(F.size("mz")).head()[0] == 0
