"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
documents; the last returns the packed pieces. Benchmark and labels are read from sf_dir.

A null text counts as an empty one and stays as it is; a null id keeps its row through every filter of copies.
Repeated rows: near_dedup leaves one. Empty tables give no rows. Further columns ride along, whatever their names; texts
of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.llm._common import stored
from ionframe.llm.decontaminate import keep_clean
from ionframe.llm.lines import dedup_lines
from ionframe.llm.minhash import keep_one
from ionframe.llm.packing import pack
from ionframe.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before; a document that loses all its text goes, and
    n_chars, if there is such a column, is counted anew where lines went."""
    out = dedup_lines(docs).where("n_removed = 0 or trim(BOTH ' \t\r\n' FROM text) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]
ORACLE_SQL = None  # a trained field and sketches; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
