"""Every query with SQL against DuckDB on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

from ionframe.operators.calibrate import lowess
from ionframe.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def rows(frame, cols):
    return sorted(map(tuple, frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def dense_lowess(x, y, frac):
    """All pairs of points, by definition: nearest share, tricube, three bisquare rounds."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    d = x[None, :] - x[:, None]
    k = int(np.ceil(frac * len(x)))
    reach = np.sort(np.abs(d), 1)[:, k - 1 : k]
    near = np.where(np.abs(d) <= reach, (1 - np.clip(np.abs(d) / (1.0001 * reach), 0, 1) ** 3) ** 3, 0)
    robust = np.ones(len(x))
    for _ in range(4):
        w = near * robust
        mx, my = (w @ x) / w.sum(1), (w @ y) / w.sum(1)
        dx = x[None, :] - mx[:, None]
        fit = my + (w * dx * (y[None, :] - my[:, None])).sum(1) / (w * dx * dx).sum(1) * (x - mx)
        r = np.abs(y - fit)
        robust = np.clip(1 - (r / (6 * np.median(r))) ** 2, 0, None) ** 2
    return x, fit


def test_lowess_by_blocks_equals_all_pairs():
    r = np.random.default_rng(3)
    x = r.random(3000) * 2.6 + 1.7e3
    y = np.sin(3 * x) + r.standard_cauchy(3000) * 0.2
    got, want = lowess(x, y, 0.3), dense_lowess(x, y, 0.3)
    assert np.array_equal(got[0], want[0]) and np.abs(got[1] - want[1]).max() < 1e-9


def test_calibration_curves_fit_all_rows(spark):
    e = pd.read_parquet(f"{SF}/events.parquet", columns=["event_type", "ts", "value"])
    got = {r.event_type: (r.knots, r.mean_fit) for r in q.QUERIES["calibration_curves"](spark, SF).collect()}
    own = dict(list(e.groupby("event_type")))
    assert set(got) == set(own)
    for k, part in own.items():
        x, fit = dense_lowess(part["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e12, part["value"].to_numpy(), 0.3)
        assert got[k][0] == len(x) == len(part) and abs(got[k][1] - fit.mean()) < 1e-4
