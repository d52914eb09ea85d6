"""Helpers shared by the text operators: shared tables, connected components, hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir, stored  # noqa: F401  the operators take them from here


def only(df: DataFrame, **named: str) -> DataFrame:
    """The named columns alone, under fixed names, so that further or clashing columns of the
    caller can't reach an operator's joins: only(df, doc_id="id")."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in named.items()])


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = np.atleast_1d(x)
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Slices of a batch whose values in a string column have about `limit` bytes together,
    so that a batch of very long texts needs no more memory than one of short ones."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        size += int(n)
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _forest(batches):
    """(node, to): each node of the task's edges (a, b) with the smallest node that it is connected to."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]  # halves the path
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in list(up)], pa.int64())], names=["node", "to"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 1 << 14) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node.

    Contraction: each node hooks to the neighbour (or itself) with the smallest hash of that
    round, edges move to the hooks, and equal ends vanish. A round leaves a fraction of the
    nodes, whatever the diameter, and hubs cost no more than their edges: minima are combined
    before the shuffle. The last `few` edges at most, a bound that doesn't grow with the input, are joined up in
    one task, which saves the many rounds over next to nothing. Nulls link nothing; repeated edges count once.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = stored(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while (left := e.count()) > few:
        seed = F.lit(len(hooks))
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("to"))
        hook = both.groupBy("a").agg(F.min(best).alias("m"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("to"))
        hook = stored(hook.select(F.col("a").alias("node"), F.least("m", own)["to"].alias("to")), "hooks")
        hooks.append(hook)
        moved = e.join(hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        e = stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    if left:
        hooks.append(stored(e.coalesce(1).mapInArrow(_forest, "node long, to long"), "hooks"))
    if not hooks:
        return spark.createDataFrame([], "node long, component long")
    top = hooks[-1]
    for hook in reversed(hooks[:-1]):
        above = top.select(F.col("node").alias("to"), F.col("to").alias("root"))
        top = hook.join(above, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    if len(hooks) == 1 and left:  # no edge was moved: a root is its component's smallest node
        return top.withColumnRenamed("to", "component")
    top = stored(top, "roots")
    least = stored(top.groupBy("to").agg(F.min("node").alias("component")), "least")
    return top.join(least, "to").select("node", "component")
