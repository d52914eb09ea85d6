"""Readers: mzML, library tables, SQLite libraries, features, FASTA, results, run parameters."""

from __future__ import annotations

import json
import re
import sqlite3
import tempfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.peptide import fragment_name, named_peaks, split_fragment, stripped

SCANS = "run string, scan_num long, ms_level int, rt double, inj_time double, tic double, prec_mz double, win_lo double, win_hi double, ce double, scan_lo double, scan_hi double, mz array<double>, intensity array<double>"

# Accessions of the mzML vocabulary.
LEVEL, TIME, TIC, INJECTION, TARGET, LOWER, UPPER, ENERGY, SCAN_LO, SCAN_HI = "MS:1000511", "MS:1000016", "MS:1000285", "MS:1000927", "MS:1000827", "MS:1000828", "MS:1000829", "MS:1000045", "MS:1000501", "MS:1000500"
MZ, INTENSITY, F32, ZIP, MINUTE = "MS:1000514", "MS:1000515", "MS:1000521", "MS:1000574", "UO:0000031"


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def _param(head: Column, accession: str) -> Column:
    """The last cvParam tag with an accession; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(head, F.lit(rf"<(?:\w+:)?cvParam\s[^>]*\b{accession}\b[^>]*>"), F.lit(0)), F.lit(-1))


def _decoded(mz: pd.Series, mz_marks: pd.Series, intensity: pd.Series, intensity_marks: pd.Series) -> pd.DataFrame:
    """Arrays of a spectrum from their bytes and the marks before them, sorted by m/z; missing ones are empty."""

    def values(raw, marks) -> np.ndarray:
        raw = zlib.decompress(raw) if raw and ZIP in marks else raw or b""
        return np.frombuffer(raw, "<f4" if F32 in (marks or "") else "<f8").astype(float)

    rows = []
    for a, am, b, bm in zip(mz, mz_marks, intensity, intensity_marks, strict=True):
        x, y = values(a, am), values(b, bm)
        order = np.argsort(x, kind="stable")
        rows.append((x[order], y[order] if len(y) == len(x) else y))
    return pd.DataFrame(rows, columns=["mz", "intensity"])


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """Scans of levels 1 and 2 of one or many mzML files, in any store that Spark reads.

    Files are split where spectra end, so many tasks read one file, and a row is a spectrum's text at most. Its attributes are taken from the text
    by expressions; the arrays are decoded last, so that a filter on them (ms_level, rt) comes first and a plan that needs no peaks decodes none. Times are in
    minutes; a scan without a number in its id has its index plus one.
    """
    text = spark.read.option("lineSep", "</spectrum>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"(?s)<(?:\w+:)?spectrum\s(.*)$", 1).alias("x")).where("x <> ''")
    tag, head = F.substring_index("x", ">", 1), F.substring_index("x", "<binaryDataArrayList", 1)
    number = lambda accession: _attribute(_param(F.col("head"), accession), "value").try_cast("double")
    own = text.select("file", "x", F.concat(F.lit(" "), tag).alias("tag"), head.alias("head"))
    time = number(TIME) / F.when(_attribute(_param(F.col("head"), TIME), "unitAccession") == MINUTE, 1).otherwise(60)
    scan = F.nullif(F.regexp_extract(F.coalesce(_attribute(F.col("tag"), "id"), F.lit("")), r"scan=(\d+)", 1), F.lit("")).cast("long")
    run = F.substring_index(F.element_at(F.split("file", "/"), -1), ".", 1)
    own = own.select(run.alias("run"), F.coalesce(scan, F.coalesce(_attribute(F.col("tag"), "index").cast("long"), F.lit(0)) + 1).alias("scan_num"), number(LEVEL).cast("int").alias("ms_level"), time.alias("rt"), (number(INJECTION) / 1000).alias("inj_time"), number(TIC).alias("_tic"), number(TARGET).alias("prec_mz"), number(LOWER).alias("_lo"), number(UPPER).alias("_hi"), number(ENERGY).alias("ce"), number(SCAN_LO).alias("scan_lo"), number(SCAN_HI).alias("scan_hi"), F.slice(F.split("x", r"<binaryDataArray\s*(?=[\s>])"), 2, 1_000_000).alias("_boxes")).where("ms_level in (1, 2)")
    box = lambda accession: F.try_element_at(F.filter("_boxes", lambda b: F.substring_index(b, "<binary>", 1).contains(accession)), F.lit(-1))
    data = lambda b: F.when(b.contains("<binary>"), F.unbase64(F.substring_index(F.substring_index(b, "<binary>", -1), "</binary>", 1)))
    marks = lambda b: F.substring_index(b, "<binary>", 1)
    arrays = F.pandas_udf(_decoded, "mz array<double>, intensity array<double>")
    a, b = box(MZ), box(INTENSITY)
    own = own.withColumn("_arrays", arrays(data(a), marks(a), data(b), marks(b)))
    tic = F.coalesce("_tic", F.aggregate("_arrays.intensity", F.lit(0.0), lambda s, v: s + v))
    return own.withColumns({"tic": tic, "win_lo": F.col("prec_mz") - F.col("_lo"), "win_hi": F.col("prec_mz") + F.col("_hi"), "mz": F.col("_arrays.mz"), "intensity": F.col("_arrays.intensity")}).select(*[c.split(" ")[0] for c in SCANS.split(", ")])


# Headers accepted for each library column, the first present counts.
HEADERS = {
    "mod_seq": ("ModifiedPeptide", "ModifiedSequence", "modification_sequence"),
    "seq": ("StrippedPeptide", "PeptideSequence", "stripped_sequence"),
    "charge": ("PrecursorCharge", "prec_z"),
    "prec_mz": ("PrecursorMz", "Q1"),
    "irt": ("Tr_recalibrated", "RT", "iRT"),
    "ion": ("FragmentType", "frg_type"),
    "idx": ("FragmentNumber", "FragmentSeriesNumber", "frg_nr"),
    "frag_charge": ("FragmentCharge", "frg_z"),
    "loss": ("FragmentLossType", "frg_loss"),
    "mz": ("FragmentMz", "ProductMz", "Q3"),
    "intensity": ("RelativeIntensity", "LibraryIntensity", "relative_intensity"),
    "im": ("IonMobility",),
    "protein_group": ("ProteinGroup",),
    "protein_name": ("ProteinName", "ProteinID", "ProteinId"),
    "genes": ("GeneName", "Genes"),
    "uniprot_id": ("UniprotID",),
}
NEEDED = ("mod_seq", "seq", "charge", "prec_mz", "irt", "ion", "idx", "frag_charge", "mz", "intensity")
NUMBERS = {"charge": "int", "prec_mz": "double", "irt": "double", "idx": "int", "frag_charge": "int", "mz": "double", "intensity": "double", "im": "double"}


def library_columns(df: DataFrame) -> DataFrame:
    """A library table with fixed names and types from any accepted headers; columns that lack are null."""
    picked: list[Column] = []
    for name, headers in HEADERS.items():
        held = [h for h in headers if h in df.columns]
        if not held and name in NEEDED:
            raise ValueError(f"library has none of {headers}")
        c = F.col(f"`{held[0]}`") if held else F.lit(None).cast("string")
        if name == "charge" or name == "idx" or name == "frag_charge":
            picked.append(c.try_cast("double").cast("int").alias(name))
        else:
            picked.append((c.try_cast(NUMBERS[name]) if name in NUMBERS else c).alias(name))
    return df.select(*[c for c in picked], *[c for c in df.columns if c.startswith("_ord")])


def read_library(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """One row per (mod_seq, charge) with `frags` sorted by m/z. Of repeated fragments, and for a
    precursor's own columns, the last row of the file counts."""
    raw = spark.read.csv(path, sep=sep, header=True)
    rows = library_columns(raw.withColumn("_ord", F.monotonically_increasing_id()))
    rows = rows.withColumn("mod_seq", F.trim(F.col("mod_seq"), F.lit("_"))).withColumn("name", fragment_name(F.col("ion"), F.col("idx"), F.col("loss"), F.col("frag_charge")))
    key = ["mod_seq", "charge"]
    last = rows.groupBy(*key, "name").agg(F.max_by(F.struct("mz", "intensity"), "_ord").alias("p"))
    frags = last.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"), "name"))).alias("frags"))
    own = ["seq", "prec_mz", "irt", "im", "protein_group", "protein_name", "genes", "uniprot_id"]
    head = rows.groupBy(*key).agg(*[F.max_by(c, "_ord").alias(c) for c in own])
    return head.join(frags, key).withColumn("is_decoy", F.lit(False))


def library_fragments(library: DataFrame) -> DataFrame:
    """One row per fragment, with its parts, share of the precursor's intensity and rank by intensity."""
    from pyspark.sql import Window

    rows = library.select("prec_id", "is_decoy", "mod_seq", "charge", "prec_mz", F.posexplode("frags").alias("ord", "f"))
    rows = rows.select("prec_id", "is_decoy", "mod_seq", "charge", "prec_mz", "ord", "f.name", "f.mz", "f.intensity").withColumn("s", split_fragment(F.col("name")))
    w = Window.partitionBy("prec_id", "is_decoy")
    return rows.select("*", "s.ion", "s.idx", "s.loss", "s.iso").drop("s").withColumn("norm_int", F.col("intensity") / F.sum("intensity").over(w)).withColumn("top_rank", F.row_number().over(w.orderBy(F.desc("intensity"), "ord")))


def read_blib(spark: SparkSession, path: str) -> DataFrame:
    """(mod_seq, charge, prec_mz, irt, mz, intensity) of SQLite spectrum libraries."""

    def parse(batches):
        for part in batches:
            for raw in part["content"]:
                with tempfile.NamedTemporaryFile(suffix=".blib") as f:  # SQLite reads files only; the copy lives as long as the task
                    f.write(bytes(raw))
                    f.flush()
                    with sqlite3.connect(f.name) as db:
                        cursor = db.execute("select peptideModSeq, precursorCharge, precursorMZ, retentionTime, numPeaks, peakMZ, peakIntensity from RefSpectra s join RefSpectraPeaks p on s.id = p.RefSpectraID order by s.id")
                        while rows := cursor.fetchmany(500):
                            yield pd.DataFrame([(s, int(z), m, rt, _blob(a, n, "<f8"), _blob(b, n, "<f4")) for s, z, m, rt, n, a, b in rows], columns=["mod_seq", "charge", "prec_mz", "irt", "mz", "intensity"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "mod_seq string, charge int, prec_mz double, irt double, mz array<double>, intensity array<double>")


def _blob(raw: bytes, n: int, kind: str) -> list[float]:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(raw if len(raw) == size else zlib.decompress(raw), kind).astype(float).tolist()


def read_any_library(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """A library by its kind: .blib files as SQLite, whose peaks get the names of the b and y ions that they fit (others go, and entries without
    any), others as tables. With a cache folder the parsed library is written there as Parquet
    once and read from there afterwards; delete the folder when the source changes."""
    if cache and exists(spark, f"{cache}/_SUCCESS"):
        return spark.read.parquet(cache)
    if path.rstrip("/").endswith(".blib"):
        raw = read_blib(spark, path)
        frags = named_peaks(F.col("mod_seq"), F.col("mz"), F.col("intensity"))
        none = {c: F.lit(None).cast("double" if c == "im" else "string") for c in ("im", "protein_group", "protein_name", "genes", "uniprot_id")}
        library = raw.select("mod_seq", "charge", stripped(F.col("mod_seq")).alias("seq"), "prec_mz", "irt", *[v.alias(k) for k, v in none.items()], frags.alias("frags"), F.lit(False).alias("is_decoy")).where(F.size("frags") > 0)
    else:
        library = read_library(spark, path)
    if cache:
        library.write.mode("overwrite").parquet(cache)
        library = spark.read.parquet(cache)
    return library


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_scans(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """Scans of mzML files, from the run cache if it is there, else parsed and, with a cache folder, written to it."""
    from .writers import write_scans

    if not cache:
        return read_mzml(spark, path)
    if not exists(spark, f"{cache}/_SUCCESS"):
        write_scans(read_mzml(spark, path), cache)
    return spark.read.parquet(cache).select(*[c.split(" ")[0] for c in SCANS.split(", ")])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True)
    names = {"mz": "mz", "charge": "charge", "rtApex": "rt_apex", "rtStart": "rt_start", "rtEnd": "rt_end", "intensityApex": "intensity_apex"}
    return raw.select(*[F.col(a).try_cast("int" if b == "charge" else "double").alias(b) for a, b in names.items()])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, description, sequence) of UniProt-style entries; others are left out."""
    text = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    head, body = F.regexp_extract("value", r"^([^\n]*)", 1), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    return text.select(F.regexp_extract(head, r"^[a-z]{2}\|([^|]*)\|", 1).alias("accession"), head.alias("description"), body.alias("sequence")).where("accession <> ''")


def unique_peptides(peptides: DataFrame) -> DataFrame:
    """(organism, peptide) pairs of peptides that one organism alone has."""
    return peptides.groupBy("peptide").agg(F.min("organism").alias("organism"), F.countDistinct("organism").alias("n")).where("n = 1").select("organism", "peptide")


RESULT_LISTS = ("frag_names", "frag_errors", "frag_mz", "frag_int", "obs_int", "unique_frag_mz", "unique_obs_int")
RESULT_FEATURES = "hyperscore b_counts y_counts longest_y scribe max_matched_residuals max_unmatched_residuals gof_stats manhattan_distances fitted_spectral_contrasts num_lib frac_lib_int frac_dia_int mz_error rt_error frac_int_matched frac_int_pred frac_int_matched_pred spec_r2 prec_r2 prec_r2_uniq frac_int_uniq frac_int_uniq_pred frac_int_matched_pred_sigcoeff cosine mz".split()


def result_schema(time_channel: bool = False) -> str:
    head = ["coeff double", "spec_id long", "ms1_spec_id long", "seq string", "z int", *(["time_channel int"] if time_channel else []), "window_mz double", "rt double"]
    return ", ".join([*head, *[f"{f} double" for f in RESULT_FEATURES], *[f"{c} string" for c in RESULT_LISTS], "file_name string", "protein string"])


def read_results(spark: SparkSession, path: str, time_channel: bool = False) -> DataFrame:
    """Headerless result rows, with the `;` lists as arrays and a decoy flag."""
    from ..functions.peptide import split_numbers

    df = spark.read.schema(result_schema(time_channel)).csv(path)
    lists = {c: F.split(c, ";") if c == "frag_names" else split_numbers(F.col(c)) for c in RESULT_LISTS}
    return df.withColumns(lists | {"decoy": F.col("seq").contains("Decoy_")})


def read_params(spark: SparkSession, path: str) -> dict:
    """`key: value` lines under headings; values are read as JSON where they are, with True, False and None, and as text otherwise."""
    out: dict[str, dict] = {}
    part = out.setdefault("", {})
    for line in spark.read.text(path, wholetext=True).head()[0].splitlines():
        key, colon, value = line.partition(":")
        if not colon:
            part = out.setdefault(line.strip(), {}) if line.strip() else part
            continue
        value = value.strip()
        value = {"True": "true", "False": "false", "None": "null"}.get(value, value)
        try:
            part[key.strip()] = json.loads(value)
        except ValueError:
            part[key.strip()] = value
    return {k: v for k, v in out.items() if v}
