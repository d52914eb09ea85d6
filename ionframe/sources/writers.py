"""Sinks. All overwrite, so that a repeated run doubles nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.peptide import split_fragment

# The library table's header.
LIBRARY_HEADER = ("ModifiedPeptide", "StrippedPeptide", "PrecursorCharge", "PrecursorMz", "RT", "IonMobility", "ProteinGroup", "ProteinName", "Genes", "FragmentType", "FragmentNumber", "FragmentCharge", "FragmentLossType", "FragmentMz", "RelativeIntensity")


def write_scans(scans: DataFrame, path: str) -> None:
    scans.write.mode("overwrite").partitionBy("ms_level").parquet(path)


def write_library(library: DataFrame, path: str) -> None:
    """One row per fragment in the fixed header's order."""
    f = split_fragment(F.col("f.name"))
    rows = library.select("*", F.explode("frags").alias("f")).withColumn("s", f)
    values = ["mod_seq", "seq", "charge", "prec_mz", "irt", "im", "protein_group", "protein_name", "genes", "s.ion", "s.idx", "s.charge", F.coalesce("s.loss", F.lit("noloss")), "f.mz", "f.intensity"]
    rows.select(*[(F.col(v) if isinstance(v, str) else v).alias(h) for v, h in zip(values, LIBRARY_HEADER, strict=True)]).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_result_rows(psm: DataFrame, path: str) -> None:
    """Result rows as headerless CSV in the readers' column order; arrays are joined by `;`, columns that lack are empty."""
    from .readers import RESULT_LISTS, result_schema

    cols = [c.split(" ")[0] for c in result_schema().split(", ")]
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ";") if c in RESULT_LISTS else F.col(c)
    psm.select(*[(text(c) if c in psm.columns else F.lit(None).cast("string")).alias(c) for c in cols]).write.mode("overwrite").csv(path)


def write_first_search(psm: DataFrame, path: str) -> None:
    """The matches that the calibration rests on."""
    psm.write.mode("overwrite").parquet(path)


def write_calibration(spark, calibration, path: str) -> None:
    """A calibration's knot tables and tolerances as JSON; of_json reads them back."""
    spark.createDataFrame([(calibration.as_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_calibration(spark, path: str):
    from ..operators.calibrate import Calibration

    return Calibration.of_json(spark.read.text(path).head()["value"])


def write_results(df: DataFrame, path: str, threshold: float = 0.01) -> None:
    """all_ids, filtered_ids (targets below the threshold by the best channel's q-value) and the narrow table."""
    df.write.mode("overwrite").parquet(f"{path}/all_ids")
    df.where(~F.col("decoy") & (F.col("best_channel_qvalue") < threshold)).write.mode("overwrite").parquet(f"{path}/filtered_ids")
    narrow = ["stripped_seq", "z", "untag_prec", "file_name", "channel", "decoy", "qvalue", "protein_qvalue", "score", "protein"]
    df.select(*[c for c in narrow if c in df.columns]).write.mode("overwrite").parquet(f"{path}/narrow")


def write_summary(df: DataFrame, path: str, threshold: float = 0.01) -> None:
    """Identified precursors and proteins per channel, as text."""
    counts = df.where(~F.col("decoy") & (F.col("qvalue") < threshold)).groupBy("run", "channel").agg(F.countDistinct("untag_prec").alias("p"), F.countDistinct("protein").alias("q"))
    counts.orderBy("run", "channel").select(F.format_string("%s %s: %d precursors, %d proteins", "run", "channel", "p", "q").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_params(spark, params: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
