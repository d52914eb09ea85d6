"""Functions for Spark SQL: table functions, pandas UDFs and SQL expressions under fixed names.

    register(spark)
    spark.sql("SELECT d.* FROM proteins p, LATERAL digest(p.sequence, 2, 5, 50) d")
    spark.sql("SELECT d.* FROM peptides p, LATERAL isotope_pattern(p.seq, 6) d")
    spark.sql("SELECT scan, nnls(collect_list(array(a, b)), collect_list(o)) FROM rows GROUP BY scan")
    spark.sql("SELECT lowess_predict(x, knots, fitted) FROM points CROSS JOIN curve")
    spark.sql("SELECT * FROM peaks WHERE within_ppm(mz, centre, 10)")
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .constants import MOD_ATOMS, PROTON, RESIDUE_ATOMS
from .isotopes import pattern

_SITE = re.compile("(?<=[KR])(?!P)")
_MOD = re.compile(r"\(((?:[^()]|\([^()]*\))*)\)|\[([^\]]*)\]")


class Digest:
    """(start, missed, peptide) of each tryptic peptide of a protein: cuts after K or R but not before P, with up to `missed` cuts left out, of
    `shortest` to `longest` residues; start counts from 1. A null protein has none."""

    def eval(self, protein: str, missed: int, shortest: int, longest: int) -> Iterator[tuple]:
        parts = [p for p in _SITE.split(protein or "") if p]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
        for i in range(len(parts)):
            for k in range(min(missed, len(parts) - 1 - i) + 1):
                peptide = protein[starts[i] : starts[i + k + 1]]
                if shortest <= len(peptide) <= longest:
                    yield starts[i] + 1, k, peptide


class IsotopePattern:
    """(iso, share) of the first n isotopes of a peptide with its modifications; nothing where an atom count isn't known."""

    def __init__(self):
        self.atoms, self.known = RESIDUE_ATOMS | MOD_ATOMS, {}

    def eval(self, sequence: str, n: int) -> Iterator[tuple]:
        if not sequence:
            return
        bare, mods = sequence, []
        if "(" in sequence or "[" in sequence:
            bare, mods = _MOD.sub("", sequence), [a or b for a, b in _MOD.findall(sequence)]
        atoms = [self.atoms.get(x) for x in (*bare, *mods)]
        if not bare or None in atoms:
            return
        key = (*map(sum, zip(*atoms, (0, 2, 0, 1, 0), strict=True)), n)  # peptides of one composition are many
        if key not in self.known:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[key] = pattern(key[:-1], n).tolist()
        yield from enumerate(self.known[key])


def lowess_predict(x: pd.Series, knots: pd.Series, fitted: pd.Series) -> pd.Series:
    """A fitted curve at x, clamped at its ends: knots in rising order and their fits, as local_regression gives them; null where any is null."""
    out = np.full(len(x), np.nan)
    for i, (at, k, v) in enumerate(zip(x, knots, fitted, strict=True)):
        if at is not None and at == at and k is not None and v is not None and len(k):
            out[i] = np.interp(at, np.asarray(k, float), np.asarray(v, float))
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def nnls_rows(rows: pa.Array, observed: pa.Array) -> pa.Array:
    """x >= 0 that minimises |ax - b| for each row's matrix (array of its rows) and right side; null where either is null or they differ in length."""
    from ..operators.solve import nnls, solve_alike

    count = len(rows)
    height, length = (pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (rows, observed))
    usable = (height == length) & (height > 0)
    lines, right = rows.flatten(), observed.flatten()  # of lists that aren't null
    starts = np.append(0, np.cumsum(np.maximum(height, 0))), np.append(0, np.cumsum(np.maximum(length, 0)))
    width = pc.fill_null(pc.list_value_length(lines), -1).to_numpy(zero_copy_only=False)
    cells, b_all = lines.flatten().to_numpy(zero_copy_only=False).astype(float), right.to_numpy(zero_copy_only=False).astype(float)
    cell_starts = np.append(0, np.cumsum(np.maximum(width, 0)))
    at = np.flatnonzero(usable)
    columns = width[starts[0][at]]
    if len(at) and ((np.minimum.reduceat(width, starts[0][:-1][at]) < 0).any() or len(width) != int(height[at].sum()) or (width != np.repeat(columns, height[at])).any()):
        one = lambda a, b: nnls(np.array([np.asarray(r, float) for r in a]), np.asarray(b, float)).tolist()
        return pa.array([one(rows[i].as_py(), observed[i].as_py()) if u else None for i, u in enumerate(usable)], pa.list_(pa.float64()))  # some have rows of their own lengths

    def matrix(which, most):
        own, n = at[which], int(columns[which[0]])
        a, b = np.zeros((len(own), most, n)), np.zeros((len(own), most))
        sizes = height[own]
        nth = np.repeat(np.arange(len(own)), sizes)
        k = np.arange(sizes.sum()) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
        a[nth, k] = cells[cell_starts[starts[0][own][nth] + k][:, None] + np.arange(n)]
        b[nth, k] = b_all[starts[1][own][nth] + k]
        return a, b

    ends = np.zeros(count + 1, np.int32)
    ends[at + 1] = columns
    ends = np.cumsum(ends, dtype=np.int32)
    out = np.zeros(ends[-1])
    for which, x in solve_alike(height[at], columns, matrix):
        out[ends[at[which]][:, None] + np.arange(x.shape[1])] = x
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out), mask=pa.array(~usable))


def register(spark: SparkSession) -> None:
    """Make the functions callable from spark.sql in this session; registering again replaces them."""
    spark.udtf.register("digest", F.udtf(Digest, returnType="start int, missed int, peptide string"))
    spark.udtf.register("isotope_pattern", F.udtf(IsotopePattern, returnType="iso int, share double"))
    spark.udf.register("lowess_predict", F.pandas_udf(lowess_predict, "double"))
    spark.udf.register("nnls", F.arrow_udf(nnls_rows, "array<double>"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION within_ppm(x DOUBLE, centre DOUBLE, ppm DOUBLE) RETURNS BOOLEAN RETURN abs(x - centre) <= ppm * 1e-6D * abs(centre)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mass_to_mz(mass DOUBLE, charge INT) RETURNS DOUBLE RETURN mass / charge + {PROTON!r}D")
