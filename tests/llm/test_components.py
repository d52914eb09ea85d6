"""Connected components: the same whichever edges are left for one task, and few tables for few edges."""

import numpy as np
import pytest

from ionframe import shared
from ionframe.llm._common import components


def union_find(edges):
    up = {n: n for e in edges if e[0] != e[1] for n in e}
    for a, b in edges:
        if a != b:
            least, ends = min(up[a], up[b]), {up[a], up[b]}
            up = {n: least if c in ends else c for n, c in up.items()}
    return up


@pytest.mark.parametrize("few", [0, 40, 1 << 14])
def test_components_equal_union_find(spark, few):
    r = np.random.default_rng(few)
    edges = [(int(a), int(b)) for a, b in r.integers(-100, 200, (120, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (900, 900), (500, 501)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = [tuple(x) for x in components(df, few=few).collect()]
    assert len(got) == len(dict(got)) and dict(got) == union_find(edges)
    assert components(df.where("a = b"), few=few).count() == 0


def test_few_edges_take_few_tables(spark):
    df = spark.range(3000).selectExpr("id as a", "id + 1 as b")
    before = len(shared._WRITTEN.get(spark.sparkContext.applicationId, []))
    assert [tuple(x) for x in components(df).selectExpr("count(*)", "max(component)").collect()] == [(3001, 0)]
    assert len(shared._WRITTEN[spark.sparkContext.applicationId]) - before <= 3
