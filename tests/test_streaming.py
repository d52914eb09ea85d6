"""Windows of a stream: closed ones once, late rows by the watermark, all windows in one table."""

import pytest

from ionframe.streaming.scans import read_stream, windowed, write_windows

SCHEMA = "ts timestamp, kind string, value double"


@pytest.fixture
def arrive(spark, tmp_path):
    def file(*rows):
        spark.createDataFrame([(f"2024-01-01 {t}:00", k, v) for t, k, v in rows], "ts string, kind string, value double").selectExpr("cast(ts as timestamp) ts", "kind", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    return file


def run(spark, tmp_path, **how):
    windows = windowed(read_stream(spark, f"{tmp_path}/in", SCHEMA), "ts", ["kind"], "value")
    write_windows(windows, f"{tmp_path}/out", f"{tmp_path}/state", **how).awaitTermination()
    return sorted((r.start.strftime("%H:%M"), r.kind, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_closed_windows_and_late_rows(spark, tmp_path, arrive):
    arrive(("10:01", "a", 1.0), ("10:09", "a", 2.0), ("10:02", "b", 5.0), ("10:15", "a", 4.0))
    assert run(spark, tmp_path) == []  # the watermark is at 9:45
    arrive(("10:04", "a", 8.0), ("11:00", "a", 16.0))  # late, but within the watermark
    want = [("10:00", "a", 3, 11.0), ("10:00", "b", 1, 5.0), ("10:10", "a", 1, 4.0)]
    assert run(spark, tmp_path) == want
    arrive(("10:05", "a", 99.0), ("10:31", "b", 7.0), ("12:00", "a", 1.0))  # beyond it: left out; 10:31 isn't
    assert run(spark, tmp_path) == sorted([*want, ("10:30", "b", 1, 7.0), ("11:00", "a", 1, 16.0)])


def test_all_windows_hold_late_rows(spark, tmp_path, arrive):
    arrive(("10:01", "a", 1.0), ("12:00", "a", 2.0))
    run(spark, tmp_path, closed_only=False)
    arrive(("10:02", "a", 4.0))
    assert run(spark, tmp_path, closed_only=False) == [("10:00", "a", 2, 5.0), ("12:00", "a", 1, 2.0)]
