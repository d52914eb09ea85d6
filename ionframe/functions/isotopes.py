"""Isotope patterns by convolution of per-element distributions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import ISOTOPE_STEP, ISOTOPES

ATOMS = "CHNOS"


def _trim(p: np.ndarray, relative: float) -> np.ndarray:
    """Without the tail that lies below a share of the largest value."""
    keep = np.flatnonzero(p >= relative * p.max())
    return p[: keep[-1] + 1] if len(keep) else p[:1]


@lru_cache(4096)
def _power(element: str, count: int, relative: float) -> tuple[float, ...]:
    base, out, k = np.array(ISOTOPES[element]), np.ones(1), count
    while k > 0:
        if k & 1:
            out = _trim(np.convolve(out, base), relative)
        base, k = _trim(np.convolve(base, base), relative), k >> 1
    return tuple(out)


def pattern(composition: tuple[int, ...], n: int, relative: float = 1e-5) -> np.ndarray:
    """Shares of the first n isotopes (C, H, N, O, S counts), which sum to 1 at most."""
    out = np.ones(1)
    for element, count in zip(ATOMS, composition, strict=True):
        out = _trim(np.convolve(out, np.array(_power(element, max(0, int(count)), relative))), relative)
    return np.pad(out[:n], (0, max(0, n - len(out))))


def patterns(df: DataFrame, composition: str, n: int = 6, out: str = "isotopes") -> DataFrame:
    """df with an array of n shares for a struct column (C, H, N, O, S). Distinct compositions are few, so results are cached per worker."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` array<double>"

    def run(batches):
        cache: dict = {}
        for part in batches:
            got = []
            for c in part[composition]:
                key = None if c is None else tuple(c[a] for a in ATOMS)
                if key not in cache:
                    cache[key] = None if key is None else pattern(key, n).tolist()
                got.append(cache[key])
            yield part.assign(**{out: pd.Series(got, index=part.index, dtype=object)})

    return df.mapInPandas(run, schema)


def isotope_rows(fragments: DataFrame, isotopes: str = "isotopes") -> DataFrame:
    """One row per fragment and isotope: names end in _iso<k> for k > 0, m/z moves by k steps over the charge,
    intensity is relative to the monoisotopic peak."""
    rows = fragments.select("*", F.posexplode(isotopes).alias("iso", "share"))
    mono = F.get(F.col(isotopes), 0)
    name = F.when(F.col("iso") == 0, F.col("name")).otherwise(F.concat("name", F.lit("_iso"), F.col("iso").cast("string")))
    charge = F.regexp_extract("name", r"_(\d+)$", 1).cast("int")
    return rows.withColumns({"mz": F.col("mz") + F.col("iso") * F.lit(ISOTOPE_STEP) / charge, "intensity": F.col("intensity") * F.col("share") / mono, "name": name}).drop("share", isotopes)


def precursor_isotopes(mz: Column, charge: Column, n: int = 6) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: mz + k * F.lit(ISOTOPE_STEP) / charge)
