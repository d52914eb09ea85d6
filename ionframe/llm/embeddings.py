"""Near-duplicate vectors: random-hyperplane signatures in several tables, exact cosine, components."""

from __future__ import annotations

from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, mix64, only, stored

MISS, SEED = 6e-5, 10


def sized(n: int, bound: float) -> tuple[int, int]:
    """(tables, bits) for labels of up to n vectors: about as many signatures as vectors (12 bits at
    least), and as many tables as part two vectors at the bound with probability MISS at most."""
    bits = max(12, ceil(log2(max(n, 1))))
    return ceil(log(MISS) / log1p(-((1 - acos(bound) / pi) ** bits))), bits


def planes(dim: int, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _signed(batches, tables, bits, seed):
    """Valid vectors with the key of equal (label, vector) rows and one bucket key per table."""
    normals: dict[int, np.ndarray] = {}
    for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
        rows = list(zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True))
        by: dict[int, list] = {}
        for i, v, label in rows:
            if i is None or not v or label is None or None in v:
                continue
            by.setdefault(len(v), []).append((i, v, label))
        for dim, own in by.items():
            x = np.array([v for _, v, _ in own], np.float64)
            with np.errstate(all="ignore"):
                scale = np.abs(x).max(1)
                good = np.isfinite(x).all(1) & (scale > 0)
                unit = x[good] / scale[good, None]
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            if not good.any():
                continue
            normals.setdefault(dim, planes(dim, tables, bits, seed))
            sign = (unit @ normals[dim] > 0).reshape(len(unit), tables, bits)
            code = (sign << np.arange(bits)).sum(2).astype(np.uint64)
            keep = [r for r, g in zip(own, good, strict=True) if g]
            labels = np.array([r[2] for r in keep], np.int64).view(np.uint64)
            key = mix64(mix64(mix64(labels + np.uint64(dim << 32))[:, None] ^ np.arange(1, tables + 1, dtype=np.uint64)) ^ code)
            vectors = [u.tobytes() for u in unit]
            same = [xxhash.xxh3_128_digest(v + int(r[2]).to_bytes(8, "little", signed=True)) for v, r in zip(vectors, keep, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in keep], pa.int64()), pa.array(same, pa.binary()), pa.array(vectors, pa.binary()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))],
                names=["vec_id", "same", "vector", "keys"],
            )


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that links (x, y) lead to."""
    up = np.arange(n)
    while True:
        low = up.copy()
        np.minimum.at(low, x, up[y])
        np.minimum.at(low, y, up[x])
        np.minimum.at(low, up, low)  # a root takes what its rows reach
        low = low[low]
        if (low == up).all():
            return up
        up = low


def _block(side, node, many, vector, keys, table: int, bound: float):
    """(node, links first met in this bucket, a linked node) of a block (side 0 alone) or of a pair of blocks, as arrays; None without links."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    if not len(left) or alone and len(left) < 2:
        return None
    right = left if alone else right
    unit = np.frombuffer(b"".join(vector)).reshape(len(side), -1)
    close = unit[left] @ unit[right].T >= bound
    if alone:
        np.fill_diagonal(close, False)
    x, y = np.nonzero(close)
    if not len(x):
        return None
    x, y = left[x], right[y]
    first = np.ones(len(x), bool)  # counted in the first table that holds both: none before this one does
    for k in range(table):
        first[first] = keys[x[first], k] != keys[y[first], k]
    links = np.zeros(len(side), np.int64)
    np.add.at(links, x[first], many[y[first]])
    if not alone:
        np.add.at(links, y[first], many[x[first]])
    least, seen = _least(len(side), x, y), np.unique(np.concatenate([x, y]))
    return node[seen], links[seen], node[least[seen]]


def _compare(batches, bound):
    """Rows come sorted by (bucket, i, j, side); the rows of one (bucket, i, j) are compared together. A group that
    reaches the end of a batch waits for the next one."""
    held = None

    def blocks(own, starts, ends):
        got = [_block(*(c[s:e] for c in own[3:8]), int(own[8][s]), bound) for s, e in zip(starts, ends, strict=True) if e - s > 1]
        whole = [np.concatenate(c) for c in zip(*(g for g in got if g is not None), strict=True)] or [np.empty(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in whole], names=["node", "links", "to"])

    for batch in batches:
        if not batch.num_rows:
            continue
        at = {n: batch.column(n) for n in ("bucket", "i", "j", "side", "node", "many", "vector", "keys", "nth")}
        vector = np.empty(batch.num_rows, object)
        vector[:] = at["vector"].to_pylist()
        keys = at["keys"].flatten().to_numpy().reshape(batch.num_rows, -1)
        own = [vector if n == "vector" else keys if n == "keys" else c.to_numpy() for n, c in at.items()]
        if held is not None:
            own = [np.concatenate(pair) for pair in zip(held, own, strict=True)]
        fresh = np.flatnonzero((np.diff(own[0]) != 0) | (np.diff(own[1]) != 0) | (np.diff(own[2]) != 0)) + 1
        starts = np.concatenate([[0], fresh])
        yield blocks(own, starts[:-1], starts[1:])
        held = [c[starts[-1] :] for c in own]
    if held is not None:
        yield blocks(held, [0], [len(held[0])])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", bound: float = 0.93, tables: int | None = None, bits: int | None = None, block: int = 256, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    Rows of equal labels are linked if some table's signature is equal and their cosine, in doubles, is
    bound or more. Unless they are given, bits grow with the logarithm of the largest label, so that vectors
    far apart seldom share a bucket at any size, and tables grow with the bits, so that recall stays:
    two vectors at cosine 0.93 differ in a sign with probability 0.12, so all 40 tables of 12 bits, or all
    120 of 20, part them with probability 6e-5. Equal vectors of a label (up to
    length) are one node with a multiplicity. A bucket is cut into blocks and the pairs of blocks
    are compared one by one, so no task holds a bucket; a pair's link is counted in the first table
    that holds it, and a block hands on counts and a spanning forest, never its pairs.

    A vector that is null, empty, zero, or holds null or non-finite components, or whose label is
    null, links with nothing (n_links 0, its own component). A null id keeps its row, with a null component
    and kept true, and links with nothing. Rows that repeat an id count each, and share a component. Vectors of other lengths
    are never compared. Empty input gives no rows. Other columns are ignored.
    """
    own = only(vectors, vec_id=id_col, embedding=vector_col, label=label_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    if tables is None or bits is None:
        largest = own.where("label is not null").groupBy("label").count().agg(F.max("count")).head()[0]
        tables, bits = sized(largest or 0, bound)
    signed = stored(own.mapInArrow(lambda b: _signed(b, tables, bits, seed), "vec_id long, same binary, vector binary, keys array<long>"), "signed")
    nodes = stored(signed.groupBy("same").agg(F.min("vec_id").alias("node"), F.count("*").alias("many"), F.first("vector").alias("vector"), F.first("keys").alias("keys")), "nodes")
    keyed = nodes.select("same", F.posexplode("keys").alias("nth", "bucket"))
    sizes = stored(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = keyed.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select("same", "nth", "bucket", "own", other).select("same", "nth", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    rows = dealt.join(nodes, "same").select("bucket", "i", "j", "side", "node", "many", "vector", "keys", "nth")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    found = stored(rows.mapInArrow(lambda b: _compare(b, bound), "node long, links long, to long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "to")
    labelled = stored(nodes.select("same", "node", "many").join(links, "node", "left").join(stored(roots, "roots"), "node", "left").select("same", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "labelled")
    linked = signed.select("vec_id", "same").join(labelled, "same").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = own.select("vec_id").join(stored(linked, "linked"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
