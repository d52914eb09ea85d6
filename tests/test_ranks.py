"""Global ranks, q-values and nearest values on many rows, with ties, payload columns and odd values."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ionframe.operators import joins, ranks, scoring, traces


@pytest.fixture(scope="module")
def many(spark):
    """300,000 rows with ties (a third share one score), a payload and decoys."""
    score = F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.round(F.rand(3), 3))
    df = spark.range(300_000, numPartitions=6).select("id", score.alias("score"), (F.rand(5) < 0.1).alias("decoy"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    return spark.createDataFrame(df.toPandas())  # fixed values: rand follows the plan


def test_ranks_equal_row_numbers_with_a_payload(spark, many):
    got = ranks.running(many, F.when(F.col("decoy"), 1).otherwise(0), [("score", True), ("id", False)], "decoys", parts=16)
    w = Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = many.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("r"), F.sum(F.col("decoy").cast("int")).over(w).alias("d"))
    assert got.count() == 300_000 and set(got.columns) == {"id", "score", "decoy", "payload", "decoys", "rank"}
    assert got.join(want, "id").where("rank <> r or decoys <> d").count() == 0


def test_ranges_are_even_despite_a_score_that_a_third_share(many):
    sizes = [r["count"] for r in ranks.dealt(many, [("score", True), ("id", False)], 16).groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 300_000 / 16


def test_monotone_q_values_by_definition(spark, many):
    few = many.where("id < 5000")
    got = {r.id: r.qvalue for r in scoring.qvalues(few, F.col("decoy"), "score", ["id"], made_monotone=True).collect()}
    rows = sorted(few.collect(), key=lambda r: (-r.score, r.id))
    raw, decoys = [], 0
    for n, r in enumerate(rows, 1):
        decoys += r.decoy
        raw.append(decoys / n)
    for i in range(len(raw) - 2, -1, -1):
        raw[i] = min(raw[i], raw[i + 1])
    assert {r.id: q for r, q in zip(rows, raw, strict=True)} == got


@pytest.mark.parametrize("down", [True, False])
def test_nulls_nan_and_equal_rows(spark, down):
    rows = [(1, 2.0), (2, None), (3, float("nan")), (4, -1.0), (5, 2.0), (6, None), (7, 0.0)]
    df = spark.createDataFrame(rows, "id int, x double")
    got = {r.id: r["rank"] for r in ranks.running(df, F.lit(1), [("x", down), ("id", False)], "s", parts=5).collect()}
    want = {r.id: r["rn"] for r in df.select("id", F.row_number().over(Window.orderBy(F.desc("x") if down else F.asc("x"), "id")).alias("rn")).collect()}
    assert got == want


@pytest.mark.parametrize("kind", ["string", "date", "timestamp_ntz", "decimal(10,2)", "long"])
def test_order_columns_of_any_type(spark, kind):
    text = {"string": "cast(id * 7 % 50 as string)", "date": "date_add(date'2020-01-01', cast(id * 7 % 50 as int))", "timestamp_ntz": "timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 7 % 50)"}.get(kind, f"cast(id * 7 % 50 as {kind})")
    df = spark.range(200).select("id", F.expr(text).alias("x"))
    got = {r.id: r["rank"] for r in ranks.running(df, F.lit(1), [("x", True), ("id", True)], "s", parts=6).collect()}
    want = {r.id: r["rn"] for r in df.select("id", F.row_number().over(Window.orderBy(F.desc("x"), F.desc("id"))).alias("rn")).collect()}
    assert got == want


def test_empty_tables(spark, many):
    assert scoring.qvalues(many.where("false"), F.col("decoy"), "score", ["id"], made_monotone=True).count() == 0


def test_nearest_and_interpolation_of_one_key_are_linear(spark):
    """One key with 400,000 rows; a frame that is summed anew for each row would take hours."""
    left = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 2 + 1).alias("x"))
    right = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("x"), F.col("id").cast("double").alias("y"))
    began = time.time()
    assert joins.nearest(left, right.select("k", "x"), "x", ["k"]).where("near = x + 1 or near = x - 1").count() == 200_000
    assert traces.interpolate(left, right, ["k"], "x", "y").where("abs(interpolated - x / 2) < 1e-6").count() == 199_999
    assert time.time() - began < 60


def test_nearest_of_a_null_is_null(spark):
    left = spark.createDataFrame([(1, None), (1, 5), (2, 5), (None, 5)], "k int, x int")
    right = spark.createDataFrame([(1, 4), (1, 6), (1, None)], "k int, x int")
    assert sorted((r.k or 0, r.x or 0, r.near) for r in joins.nearest(left, right, "x", ["k"]).collect()) == [(0, 5, None), (1, 0, None), (1, 5, 6), (2, 5, None)]
