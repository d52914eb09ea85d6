"""Ranks, q-values, best rows, protein scores and channel counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .forest import forest_scores
from .ranks import exact_medians, monotone, running


def qvalues(df: DataFrame, decoy: Column, score: str, ids: list[str], out: str = "qvalue", made_monotone: bool = False) -> DataFrame:
    """Decoys among the rows at least as good, as a share of those rows. By definition not monotone; made_monotone
    gives each row the least share at or beyond it. ids tell rows of equal score apart."""
    order = [(score, True), *[(i, False) for i in ids]]
    got = running(df, F.when(decoy, 1).otherwise(0), order, "_decoys", keep_part=made_monotone)
    raw = got.withColumn(out, F.col("_decoys").cast("double") / F.col("rank")).drop("_decoys", "rank")
    return monotone(raw.withColumnRenamed(out, "_raw"), "_raw", order, out).drop("_raw") if made_monotone else raw


def best_rows(df: DataFrame, on: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where("_rn = 1").drop("_rn")


def nearby_extreme(df: DataFrame, on: list[str], position: list, peak: list, value: str, n: int = 2, how: str = "max", out: str = "nearby") -> DataFrame:
    """(key, out, n): the extreme of value within n places, in order of position, of the first row in order of peak."""
    w = Window.partitionBy(*on)
    own = df.withColumns({"_p": F.row_number().over(w.orderBy(*position)), "_k": F.row_number().over(w.orderBy(*peak))})
    own = own.withColumn("_at", F.max(F.when(F.col("_k") == 1, F.col("_p"))).over(w)).where(F.abs(F.col("_p") - F.col("_at")) <= n)
    return own.groupBy(*on).agg((F.max if how == "max" else F.min)(value).alias(out), F.count("*").alias("n"))


def protein_qvalues(df: DataFrame, protein: str, decoy: str, score: str, out: str = "protein_qvalue") -> DataFrame:
    """Targets' q-values by protein from the best score per (protein, decoy), which are stored: ranks read them several times."""
    best = stored(df.groupBy(protein, decoy).agg(F.max(score).alias("_best")), "proteins")
    return qvalues(best, F.col(decoy) == 1, "_best", [protein, decoy], out).where(F.col(decoy) == 0).select(protein, out)


def best_channel_qvalues(df: DataFrame, on: list[str], qvalue: str = "qvalue", out: str = "best_channel_qvalue") -> DataFrame:
    """df with the least q-value among the channels of each key."""
    return df.withColumn(out, F.min(qvalue).over(Window.partitionBy(*on)))


def with_channels_matched(df: DataFrame, on: list[str], out: str = "channels_matched") -> DataFrame:
    """df with the number of rows (channels) of each key."""
    return df.withColumn(out, F.count("*").over(Window.partitionBy(*on)))


def with_fragment_medians(psm: DataFrame, on: list[str], errors: str = "frag_errors", out: str = "med_frag_error") -> DataFrame:
    """psm with the median distance of each match's fragment errors (an array) from the median of all fragment errors of its run (the columns `on`)."""
    centre = exact_medians(psm.select(*on, F.explode(errors).alias("_e")), on, "_e", "_centre")
    off = F.array_sort(F.transform(errors, lambda e: F.abs(F.col("_centre") - e)))
    n = F.size(off)
    middle = (F.get(off, F.floor((n - 1) / 2).cast("int")) + F.get(off, F.floor(n / 2).cast("int"))) / 2
    return psm.join(centre, on, "left").withColumn(out, F.when(n > 0, middle)).drop("_centre")


def rank_score(df: DataFrame, on: list[str], orders: list, out: str = "rank_score") -> DataFrame:
    """df with the sum of each row's ranks within its key under several orders (lists of sort columns), the first place 1."""
    w = Window.partitionBy(*on)
    total = F.lit(0)
    for order in orders:
        total = total + F.row_number().over(w.orderBy(*order))
    return df.withColumn(out, total.cast("long"))


def medians(df: DataFrame, on: list[str], value: str) -> DataFrame:
    """(key, median, spread) of a value, such as a sequence's times over runs."""
    return df.groupBy(*on).agg(F.percentile(value, 0.5).alias("median"), (F.max(value) - F.min(value)).alias("spread"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(bin, n, density): rows in steps of width, and their share of all rows."""
    counts = df.select(F.floor(F.col(value) / width).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all"))), how="cross").select("bin", "n", (F.col("n").cast("double") / F.col("_all")).alias("density"))  # one row


def strong_precursors(psm: DataFrame, key: list[str], least: float = 1.0) -> DataFrame:
    """The best row of each key among those whose coefficient is above `least`."""
    return best_rows(psm.where(F.col("coeff") > least), key, [F.desc("coeff"), "scan_num"])


def group_folds(group: Column, folds: int = 5) -> Column:
    """Cross-validation fold of a group: a hash, so that a group never spans folds."""
    return F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")


def cross_validated(df: DataFrame, features: list[str], label: str, group: str, folds: int = 5, model: str = "rf", trees: int = 200, depth: int = 20, seed: int = 42, out: str = "score") -> DataFrame:
    """df with the class-1 probability of a model trained on the other folds.

    model: rf (random forest), gbt (boosted trees), mlp (multilayer perceptron), lda (linear discriminant in
    closed form from mean and covariance aggregates). Missing features count as 0. The rows are stored once before the
    folds, so that what made them doesn't run again for each fit. A random forest is grown over counted cells of binned features (forest.forest_scores)
    where a fold has at most 262,144 of them, and by Spark's own level after level beyond that.
    """
    from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    own = df.fillna(0.0, subset=features).withColumn("_fold", group_folds(F.col(group), folds)).withColumn("_y", F.col(label).cast("double"))
    own = stored(own, "folds")
    if model == "rf" and (got := forest_scores(own, features, "_y", "_fold", folds, trees, depth, seed, out)) is not None:
        return got.select(*df.columns, out)
    if model != "lda":
        own = VectorAssembler(inputCols=features, outputCol="_x").transform(own)
    makers = {
        "rf": lambda: RandomForestClassifier(labelCol="_y", featuresCol="_x", numTrees=trees, maxDepth=depth, seed=seed),
        "gbt": lambda: GBTClassifier(labelCol="_y", featuresCol="_x", maxIter=trees, maxDepth=min(depth, 10), stepSize=0.1, seed=seed),
        "mlp": lambda: MultilayerPerceptronClassifier(labelCol="_y", featuresCol="_x", layers=[len(features), 20, 20, 4, 2], seed=seed),
    }
    parts = None
    for k in range(folds):
        train, test = own.where(F.col("_fold") != k), own.where(F.col("_fold") == k)
        if model == "lda":
            scored = test.withColumn(out, lda(train, features, "_y"))
        else:
            scored = makers[model]().fit(train).transform(test).withColumn(out, vector_to_array("probability")[1])
        scored = scored.select(*df.columns, out)
        parts = scored if parts is None else parts.unionAll(scored)
    return parts


def lda(train: DataFrame, features: list[str], label: str) -> Column:
    """P(class 1) of a two-class linear discriminant, as an expression; one aggregation gives all moments."""
    import numpy as np

    k = len(features)
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)]
    products = [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = {r["_y"]: r for r in train.groupBy(F.col(label).alias("_y")).agg(F.count("*").alias("n"), *sums, *products).collect()}
    if set(rows) != {0.0, 1.0}:
        return F.lit(float(1.0 in rows))
    n = {y: r["n"] for y, r in rows.items()}
    mean = {y: np.array([r[f"s{i}"] for i in range(k)]) / r["n"] for y, r in rows.items()}
    scatter = np.zeros((k, k))
    for y, r in rows.items():
        for i in range(k):
            for j in range(i, k):
                scatter[i, j] += r[f"p{i}_{j}"] - n[y] * mean[y][i] * mean[y][j]
                scatter[j, i] = scatter[i, j]
    total = n[0.0] + n[1.0]
    w = np.linalg.pinv(scatter / max(1, total - 2) + 1e-9 * np.eye(k)) @ (mean[1.0] - mean[0.0])
    b = np.log(n[1.0] / n[0.0]) - 0.5 * float(w @ (mean[0.0] + mean[1.0]))
    z = F.lit(float(b))
    for f, c in zip(features, w, strict=True):
        z = z + F.col(f) * float(c)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), z)))
