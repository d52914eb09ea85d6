"""Non-negative least squares per scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """x >= 0 that minimises |ax - b| by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, rhs = a.T @ a, a.T @ b
    scale = max(1.0, float(np.abs(rhs).max(initial=0.0)))
    for _ in range(10 * n + 10):
        grad = rhs - gram @ x
        free = ~passive
        if not free.any() or grad[free].max() <= tol * scale:
            break
        passive[np.flatnonzero(free)[grad[free].argmax()]] = True
        while True:
            p = np.flatnonzero(passive)
            z = np.zeros(n)
            z[p] = np.linalg.lstsq(gram[np.ix_(p, p)], rhs[p], rcond=None)[0]
            if (z[p] > tol).all():
                x = z
                break
            low = p[z[p] <= tol]
            steps = x[low] / np.maximum(x[low] - z[low], 1e-300)
            x = x + steps.min() * (z - x)
            drop = passive & (x <= tol)
            drop[low[steps.argmin()]] = True
            passive &= ~drop
            x[~passive] = 0.0
            if not passive.any():
                break
    return x


def nnls_many(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """As nnls for many problems of one shape (count, rows, columns), all in step: a turn adds or drops columns in each that isn't done."""
    count, n = a.shape[0], a.shape[2]
    turned = a.transpose(0, 2, 1)
    gram, rhs = turned @ a, (turned @ b[:, :, None])[:, :, 0]
    limit = tol * np.maximum(1.0, np.abs(rhs).max(1, initial=0.0))
    x, passive = np.zeros((count, n)), np.zeros((count, n), bool)
    todo, inner = np.arange(count), np.zeros(count, bool)  # inner: columns were dropped, so it is solved again before another comes in
    for _ in range(10 * n * n + 10):
        outer = todo[~inner[todo]]
        grad = np.where(passive[outer], -np.inf, rhs[outer] - (gram[outer] @ x[outer][:, :, None])[:, :, 0])
        more = grad.max(1, initial=-np.inf) > limit[outer]
        passive[outer[more], grad[more].argmax(1)] = True
        todo = np.sort(np.concatenate([todo[inner[todo]], outer[more]]))
        if not len(todo):
            break
        own = passive[todo]
        z = (np.linalg.pinv(gram[todo] * (own[:, :, None] & own[:, None, :]), rcond=n * np.finfo(float).eps, hermitian=True) @ (rhs[todo] * own)[:, :, None])[:, :, 0]
        low = own & (z <= tol)
        bad = low.any(1)
        x[todo[~bad]] = np.where(own, z, 0.0)[~bad]
        inner[todo] = False
        at, low, z = todo[bad], low[bad], z[bad]
        if len(at):
            steps = np.where(low, x[at] / np.maximum(x[at] - z, 1e-300), np.inf)
            moved = x[at] + steps.min(1)[:, None] * (np.where(own[bad], z, 0.0) - x[at])
            drop = own[bad] & (moved <= tol)
            drop[np.arange(len(at)), steps.argmin(1)] = True
            passive[at] &= ~drop
            x[at] = np.where(passive[at], moved, 0.0)
            inner[at] = passive[at].any(1)
    return x


def solve_alike(rows: np.ndarray, columns: np.ndarray, matrix, cells: int = 1 << 18, most: int = 16):
    """(which, x) of problems with so many rows and columns each, solved together where they have equally many columns and about as many
    rows; matrix(which, height) gives their (a, b), filled up with rows of zeros. Those of over `most` columns are solved one by one."""
    order = np.lexsort((rows, columns))
    order = order[columns[order] > 0]
    at = 0
    while at < len(order):
        n, least = int(columns[order[at]]), int(rows[order[at]])
        end = int(np.searchsorted(columns[order], n, "right"))
        end = min(end, at + int(np.searchsorted(rows[order[at:end]], 2 * least, "right")))
        end = min(end, at + max(1, cells // max(1, 2 * least * n))) if n <= most else at + 1
        which = order[at:end]
        a, b = matrix(which, int(rows[which].max()))
        yield which, nnls_many(a, b) if n <= most else nnls(a[0], b[0])[None]
        at = end


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by keys (the first counts most), where a new combination starts in it, and the combination's number of each row in that order."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new, np.cumsum(new) - 1


def _solve_scans(scan: np.ndarray, row: np.ndarray, prec: np.ndarray, v: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scan_num, prec_id, coeff) of whole scans."""
    places = []
    for key in (row, prec):  # each row's place among its scan's rows, and each precursor's
        order, new, number = _numbered(scan, key)
        heads = np.flatnonzero(new)
        first = np.searchsorted(scan[order][heads], scan[order][heads], "left")
        place = np.empty(len(scan), np.int64)
        place[order] = (np.arange(len(heads)) - first)[number]
        places.append((place, scan[order][heads], key[order][heads]))
    (ri, row_scans, _), (ci, out_scan, out_prec) = places
    scans, first_out, n_columns = np.unique(out_scan, return_index=True, return_counts=True)
    n_rows = np.unique(row_scans, return_counts=True)[1]
    by_scan = np.argsort(scan, kind="stable")
    starts = np.append(np.searchsorted(scan[by_scan], scans), len(scan))

    def matrix(which, height):
        a, b = np.zeros((len(which), height, int(n_columns[which[0]]))), np.zeros((len(which), height))
        sizes = starts[which + 1] - starts[which]
        nth = np.repeat(np.arange(len(which)), sizes)
        at = by_scan[np.arange(sizes.sum()) + np.repeat(starts[which] - np.append(0, np.cumsum(sizes)[:-1]), sizes)]
        np.add.at(a, (nth, ri[at], ci[at]), v[at])
        b[nth, ri[at]] = o[at]
        return a, b

    coeff = np.zeros(len(out_scan))
    for which, x in solve_alike(n_rows, n_columns, matrix):
        coeff[first_out[which][:, None] + np.arange(x.shape[1])] = x
    return out_scan, out_prec, coeff


def deconvolve(rows: DataFrame, unmatched: DataFrame | None = None) -> DataFrame:
    """(scan_num, prec_id, coeff) from triples (scan_num, row, prec_id, v, o), scan by scan.

    A scan's matrix holds its candidates only (the range join bounds them), so it is small
    whatever the run; a task takes its scans in order, and solves those of a batch together. unmatched: triples with o = 0 for library peaks that nothing was seen for. Rows repeated
    for several precursors carry the same o.
    """
    own = rows if unmatched is None else rows.unionByName(unmatched)
    own = own.select(F.col("scan_num").cast("long"), F.col("row").cast("long"), F.col("prec_id").cast("long"), F.col("v").cast("double"), F.col("o").cast("double"))

    def solve(batches):
        import pyarrow as pa

        def solved(table):
            found = _solve_scans(*(table.column(c).to_numpy() for c in ("scan_num", "row", "prec_id", "v", "o")))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["scan_num", "prec_id", "coeff"])

        held, last = [], None  # rows of the scan that isn't over yet
        for batch in batches:
            if not batch.num_rows:
                continue
            scans = batch.column("scan_num").to_numpy()
            cut = int(np.searchsorted(scans, scans[-1]))  # where the batch's last scan starts
            if held and scans[-1] == last:
                held.append(batch)
                continue
            yield solved(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, last = [batch.slice(cut)], scans[-1]
        if held:
            yield solved(pa.Table.from_batches(held))

    return own.repartition("scan_num").sortWithinPartitions("scan_num").mapInArrow(solve, "scan_num long, prec_id long, coeff double")
