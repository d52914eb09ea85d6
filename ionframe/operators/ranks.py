"""Global order without one task for all rows: running sums, ranks and running minima over range partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DayTimeIntervalType, DoubleType, FloatType, IntegralType, NumericType, TimestampNTZType, TimestampType

from ..shared import stored

Order = list[tuple[str, bool]]
_AHEAD = Window.unboundedPreceding


def _ascending(df: DataFrame, order: Order) -> Column:
    """A struct that sorts upwards as rows do under the order: descending numbers are turned round, and nulls and
    NaN take the places that Spark's own ordering gives them. It ends before a descending column that isn't a number."""
    fields = []
    for i, (c, down) in enumerate(order):
        kind, x = df.schema[c].dataType, F.col(f"`{c}`")
        if down and isinstance(kind, (DateType, TimestampType, TimestampNTZType, DayTimeIntervalType)):
            x, kind = F.unix_micros(x.cast("timestamp")), None
        if down and not (kind is None or isinstance(kind, NumericType)):
            break
        if not down:
            fields += [x.isNotNull().alias(f"f{i}"), x.alias(f"v{i}")]
        elif kind is None or isinstance(kind, IntegralType):
            fields += [x.isNull().alias(f"f{i}"), F.bitwise_not(x).alias(f"v{i}")]
        else:
            late = F.when(x.isNull(), 2).when(F.isnan(x) if isinstance(kind, (DoubleType, FloatType)) else F.lit(False), 0).otherwise(1)
            fields += [late.alias(f"f{i}"), (-x).alias(f"v{i}")]
    return F.struct(*fields) if fields else F.struct(F.lit(0).alias("f"))


def dealt(df: DataFrame, order: Order, parts: int | None = None, per_part: int = 64) -> DataFrame:
    """df with `_part`, the number of its range under the order (0 and up, ranges in order).

    The bounds are fixed once, from a sample of about per_part keys a range, so `_part` follows from a row's own
    values: every plan over the result sees the same ranges, whatever columns it reads. Rows of
    equal score fall in different ranges by the columns after it. The sample sets bounds alone and drops no row.
    """
    n = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # more ranges than tasks, as a hash deals them
    keys = df.select(_ascending(df, order).alias("at"))
    rows = keys.count()
    share = min(1.0, n * per_part / max(1, rows))
    at = keys if share == 1.0 else keys.sample(share, 7)
    drawn = at.groupBy().agg(F.array_sort(F.collect_list("at")).alias("at"))  # about n * per_part keys
    wide = max(1, math.isqrt(n))
    step = F.greatest(F.lit(1), F.ceil(F.size("at") / n)).cast("int")
    some = drawn.select(F.filter("at", lambda x, i: (i > 0) & (i % step == 0)).alias("at"))
    runs = some.select(F.transform(F.sequence(F.lit(0), F.floor(F.size("at") / wide).cast("int")), lambda k: F.slice("at", k * wide + 1, wide)).alias("_runs"))
    bounds = df.sparkSession.createDataFrame(runs.collect(), runs.schema)  # one row, n keys
    own = df.withColumn("_at", _ascending(df, order)).join(F.broadcast(bounds), how="cross")
    # the last run that starts at or before the key, then the place in it
    run = F.greatest(F.lit(1), F.size(F.filter("_runs", lambda r: F.get(r, F.lit(0)) <= F.col("_at"))))
    inside = F.size(F.filter(F.element_at("_runs", run), lambda b: b <= F.col("_at")))
    return own.withColumn("_part", ((run - 1) * wide + inside).cast("int")).drop("_at", "_runs")


def _sorting(order: Order) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def running(df: DataFrame, value: Column, order: Order, out: str, parts: int | None = None, keep_part: bool = False) -> DataFrame:
    """df with two columns: `out`, the running sum of value in a global order, and `rank`, the row number.

    Rows are dealt to ranges of the order, each range numbers its own rows, and the totals of the ranges before
    (one row per range) are added. order: (column, descending) pairs that identify a row. Rows are shuffled once;
    with keep_part `_part` stays, so that a later window over it needs no further shuffle.
    """
    own = dealt(df.withColumn("_v", value), order, parts)
    w = Window.partitionBy("_part").orderBy(*_sorting(order)).rowsBetween(_AHEAD, Window.currentRow)
    totals = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_t"))
    before = Window.orderBy("_part").rowsBetween(_AHEAD, -1)  # one row per range
    base = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"))
    local = own.withColumns({"_s": F.sum("_v").over(w), "_r": F.count(F.lit(1)).over(w)})
    got = local.join(F.broadcast(base), "_part").withColumns({out: F.col("_s") + F.col("_t0"), "rank": F.col("_r") + F.col("_n0")})
    return got.drop("_v", "_s", "_r", "_n0", "_t0", *([] if keep_part else ["_part"]))


def monotone(df: DataFrame, raw: str, order: Order, out: str) -> DataFrame:
    """The smallest raw value at or beyond each row in the order's direction (best first).

    Each range takes its own running minimum from its far end, and the minima of the ranges beyond (one row per range)
    are folded in. A frame without `_part` (running with keep_part leaves it) is dealt to ranges first.
    """
    own = df if "_part" in df.columns else dealt(df, order)
    w = Window.partitionBy("_part").orderBy(*[F.asc_nulls_first(c) if down else F.desc_nulls_last(c) for c, down in order]).rowsBetween(_AHEAD, Window.currentRow)
    rest = own.groupBy("_part").agg(F.min(raw).alias("_p"))
    beyond = rest.select("_part", F.min("_p").over(Window.orderBy(F.desc("_part")).rowsBetween(_AHEAD, -1)).alias("_b"))
    return own.withColumn("_m", F.min(raw).over(w)).join(F.broadcast(beyond), "_part").withColumn(out, F.least("_m", "_b")).drop("_part", "_m", "_b")


def around(df: DataFrame, mark: Column, order: list[str], before: str, after: str) -> DataFrame:
    """df with the nearest marks at or before and at or after each row in a global rising order; null where there is none.

    A mark is a struct (null in rows that bear none) that sorts as its row does. Each range takes its own, and the last mark of the ranges
    before and the first of those beyond (one row per range) fill its ends. df should be a stored table: it is read several times.
    """
    own = dealt(df.withColumn("_m", mark), [(c, False) for c in order])
    ends = own.groupBy("_part").agg(F.min("_m").alias("_a"), F.max("_m").alias("_z"))
    ends = ends.select("_part", F.max("_z").over(Window.orderBy("_part").rowsBetween(_AHEAD, -1)).alias("_e0"), F.min("_a").over(Window.orderBy(F.desc("_part")).rowsBetween(_AHEAD, -1)).alias("_e1"))
    w, up, down = Window.partitionBy("_part"), [F.asc(c) for c in order], [F.desc(c) for c in order]
    last = lambda o: F.last("_m", ignorenulls=True).over(w.orderBy(*o).rowsBetween(_AHEAD, Window.currentRow))
    local = own.withColumns({"_l": last(up), "_r": last(down)}).join(F.broadcast(ends), "_part")
    return local.withColumns({before: F.coalesce("_l", "_e0"), after: F.coalesce("_r", "_e1")}).drop("_part", "_m", "_l", "_r", "_e0", "_e1")


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float] | None:
    """A column's quantiles, exact and interpolated between neighbours; None if it has no values. Distinct values are counted and numbered in
    ranges of their order, so no task holds them all; the driver gets two rows a share."""
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c")), "values")
    n = counts.agg(F.sum("_c")).head()[0]
    if not n:
        return None
    at = [p * (n - 1) for p in shares]
    wanted = sorted({k for x in at for k in (math.floor(x), math.ceil(x))})
    placed = running(counts, F.col("_c"), [("_x", False)], "_upto")
    ranks = F.filter(F.array(*[F.lit(k) for k in wanted]), lambda k: (k < F.col("_upto")) & (k >= F.col("_upto") - F.col("_c")))
    found = {r["k"]: r["_x"] for r in placed.select("_x", F.explode(ranks).alias("k")).collect()}  # two rows a share at most
    both = [(x, found[math.floor(x)], found[math.ceil(x)]) for x in at]
    return [lo if lo == hi else (math.ceil(x) - x) * lo + (x - math.floor(x)) * hi for x, lo, hi in both]


def exact_bounds(counts: DataFrame, key: str, value: str, n: str, parts: int) -> dict[int, list[float]]:
    """Per key (an int), the distinct values at the ends of the first parts - 1 of `parts` equal shares of its rows. counts: (key, value, n), repeated
    values count together. Values are numbered in ranges of their order, all keys at once; the driver gets at most parts rows a key, so keys must be few."""
    own = stored(counts.groupBy(F.col(key).alias("_k"), F.col(value).alias("_x")).agg(F.sum(n).alias("_c")), "values")
    total = {r["_k"]: r["_n"] for r in own.groupBy("_k").agg(F.sum("_c").alias("_n")).collect()}
    before, wanted = 0, []
    for k in sorted(total):
        wanted += [(k, before + math.ceil(total[k] * i / parts) - 1) for i in range(1, parts)]
        before += total[k]
    if not wanted:
        return {}
    placed = running(own, F.col("_c"), [("_k", False), ("_x", False)], "_upto")
    asked = F.broadcast(own.sparkSession.createDataFrame(wanted, "_k int, _at long"))
    hit = placed.join(asked, "_k").where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c"))).select("_k", "_x").distinct()
    out: dict[int, list[float]] = {}
    for r in hit.collect():
        out.setdefault(r["_k"], []).append(r["_x"])
    return {k: sorted(x) for k, x in out.items()}


def exact_medians(df: DataFrame, on: list[str], value: str, out: str = "median", accuracy: int = 100_000) -> DataFrame:
    """(on, out): each key's median, the mean of the middle two of an even number, exactly and without all of a key in one task.

    A sketch brackets the middle ranks (its rank error is under 1 / accuracy of the rows); what lies below is counted, and only distinct values within the
    bracket, a few in ten thousand, are sorted. df should be a stored table: it is read twice. Null values don't count.
    """
    own = df.where(F.col(value).isNotNull()).select(*on, F.col(value).cast("double").alias("_value"))
    off = 4.0 / accuracy
    sketch = own.groupBy(*on).agg(F.percentile_approx("_value", [0.5 - off, 0.5 + off], accuracy).alias("_b"), F.count(F.lit(1)).alias("_n"))
    sketch = sketch.select(*on, "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    inner = own.join(sketch, on).withColumn("_in", F.when(F.col("_value") < F.col("_lo"), F.lit(None)).otherwise(F.col("_value"))).where(F.col("_value") <= F.col("_hi"))
    counts = inner.groupBy(*on, "_n", "_in").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*on).orderBy(F.asc_nulls_first("_in")).rowsBetween(_AHEAD, Window.currentRow))
    placed = counts.withColumn("_upto", upto)
    middle = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_in")))
    return placed.groupBy(*on).agg(((middle(F.floor((F.col("_n") + 1) / 2)) + middle(F.floor(F.col("_n") / 2) + 1)) / 2).alias(out))
