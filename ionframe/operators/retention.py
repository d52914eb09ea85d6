"""Retention times predicted from sequences, fitted on a run's own identifications."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibrate import better_by_cdf

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
ENDS = 3  # residues of either end that have weights of their own


@dataclass(frozen=True)
class Predictor:
    """A linear model over a peptide's residues, those near its ends, classes of neighbouring residues, and its length."""

    weights: tuple[float, ...]

    def __call__(self, seq: Column) -> Column:
        weights = np.array(self.weights)

        def predicted(seqs: pa.Array) -> pa.Array:
            x = matrix(seqs) @ weights
            return pa.array(x, mask=pc.is_null(seqs).to_numpy(zero_copy_only=False))

        return F.arrow_udf(predicted, "double")(seq)


# Classes of residues for windows (acid, base, polar, aliphatic, aromatic and the rest).
CLASSES = ("DE", "HKR", "NQST", "AILMV", "FWY", "CGP")


CODES = np.full(256, 20)  # of bytes; 20: any other letter
CODES[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(20)
CLASS_OF = np.array([next(i for i, c in enumerate(CLASSES) if a in c) for a in LETTERS] + [-1])


def matrix(seqs: pa.Array) -> np.ndarray:
    """Features of bare sequences, one row each; their number doesn't depend on the sequence. Unknown letters count for nothing but the length."""
    texts = ["" if s is None else s for s in seqs.to_pylist()]
    n = np.array([len(s) for s in texts], np.int64)
    codes = CODES[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)]  # a byte a letter
    row, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    place = np.arange(len(codes)) - starts[row]
    own, classes = np.zeros((len(n), 21)), np.zeros((len(n), len(CLASSES) ** 2))
    np.add.at(own, (row, codes), 1.0)
    ends = np.zeros((len(n), 2 * ENDS, 21))
    for i in range(ENDS):
        first, last = place == i, place == n[row] - 1 - i
        ends[row[first], i, codes[first]] = 1.0
        ends[row[last], ENDS + i, codes[last]] = 1.0
    a, b = CLASS_OF[codes[:-1]], CLASS_OF[codes[1:]]
    pairs = np.flatnonzero((row[:-1] == row[1:]) & (a >= 0) & (b >= 0))
    np.add.at(classes, (row[pairs], a[pairs] * len(CLASSES) + b[pairs]), 1.0)
    return np.concatenate([np.ones((len(n), 1)), np.log(1.0 + n)[:, None], n[:, None], own[:, :20], ends[:, :, :20].reshape(len(n), -1), classes], 1)


def features(seq: Column) -> Column:
    """The rows of matrix as arrays; null for a null sequence."""

    def arrays(seqs: pa.Array) -> pa.Array:
        x = matrix(seqs)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()), mask=pc.is_null(seqs))

    return F.arrow_udf(arrays, "array<double>")(seq)


def fit(ids: DataFrame, seq: str, rt: str, ridge: float = 0.1) -> Predictor:
    """Ridge regression of times on features; one aggregation sums the products (their number is fixed), and the driver solves the normal equations."""
    rows = ids.where(F.col(seq).isNotNull() & F.col(rt).isNotNull()).select(F.col(seq).alias("s"), F.col(rt).cast("double").alias("t"))

    def products(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v = np.column_stack([matrix(batch.column("s")), batch.column("t").to_numpy(zero_copy_only=False)])
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "p"])

    sums = rows.mapInArrow(products, "at int, p double").groupBy("at").agg(F.sum("p").alias("p")).toPandas()  # fixed: features squared
    if sums.empty:
        raise ValueError("no identifications to learn from")
    m = sums.sort_values("at")["p"].to_numpy()
    m = m.reshape(round(len(m) ** 0.5), -1)
    penalty = np.full(len(m) - 1, ridge)
    penalty[0] = 1e-9
    return Predictor(tuple(np.linalg.solve(m[:-1, :-1] + np.diag(penalty), m[:-1, -1]).tolist()))


def chosen(matches: DataFrame, library_rt: Column, seq: str, rt: str, folds: int = 3, least: int = 1000, ridge: float = 0.1) -> Predictor | None:
    """A predictor of run times fitted on all matches, if it does better than library_rt (the calibrated library time): the area under the distribution of
    absolute errors, where every match is predicted by a model that hasn't seen its sequence. None if not, or with under `least` matches."""
    if matches.count() < least:
        return None
    fold = F.pmod(F.xxhash64(seq), F.lit(folds))
    errors = None
    for k in range(folds):
        model = fit(matches.where(fold != k), seq, rt, ridge)
        part = matches.where(fold == k).select((F.col(rt) - library_rt).alias("own"), (F.col(rt) - model(F.col(seq))).alias("predicted"))
        errors = part if errors is None else errors.unionAll(part)
    grid = [i / 1000 for i in range(1, 1000)]
    got = errors.agg(F.percentile_approx(F.abs("own"), grid, 10_000).alias("own"), F.percentile_approx(F.abs("predicted"), grid, 10_000).alias("predicted")).head()
    return fit(matches, seq, rt, ridge) if better_by_cdf(np.array(got["own"]), np.array(got["predicted"])) else None
