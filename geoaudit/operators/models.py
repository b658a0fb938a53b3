"""Readers of feature tables: classifiers over folds, tuning, transfer, importances.

Fits are ``pyspark.ml`` estimators, distributed over their rows; a fold is a
filter, and scores of the left-out rows are put together again.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaudit.functions.ranking import rank_metrics
from geoaudit.session import materialise


def balanced(df: DataFrame, label: str = "y") -> DataFrame:
    """Append ``weight``: n / (2 n_class), so that both classes weigh the same."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__t"))
    return df.join(F.broadcast(counts), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("__t") / (2.0 * F.col("__n"))).drop("__n", "__t")  # two rows, one row


def reader(kind: str, seed: int = 42, **params: float) -> list[Estimator]:
    """Stages that read ``x`` and ``y``: random forest, boosted trees or logistic regression."""
    if kind == "forest":
        return [RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=int(params.get("trees", 300)), maxDepth=int(params.get("depth", 12)), minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed)]
    if kind == "boosting":
        return [GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=int(params.get("rounds", 300)), stepSize=params.get("rate", 0.1), maxDepth=int(params.get("depth", 5)), seed=seed)]
    if kind == "logistic":
        return [StandardScaler(inputCol="x", outputCol="xs", withMean=True), LogisticRegression(featuresCol="xs", labelCol="y", weightCol="weight", regParam=params.get("reg", 1e-3), elasticNetParam=0.0, standardization=False, maxIter=int(params.get("iterations", 100)))]
    raise ValueError(kind)


def fit(train: DataFrame, features: list[str], stages: list[Estimator]) -> object:
    """A pipeline fitted on ``train`` with class-balancing weights."""
    rows = balanced(train).persist()  # estimators pass over their rows many times; lost blocks are computed again
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip"), *stages]).fit(rows)
    rows.unpersist()
    return model


def scores(model: object, df: DataFrame, name: str = "score") -> DataFrame:
    """Append the probability of label 1."""
    out = model.transform(df.withColumn("weight", F.lit(1.0)))
    return out.select(*df.columns, vector_to_array("probability")[1].alias(name))


def out_of_fold(df: DataFrame, features: list[str], make: Callable[[], list[Estimator]], k: int) -> DataFrame:
    """Scores of every row from the model of the other folds; ``df`` has ``fold`` and ``y``."""
    parts = [scores(fit(df.where(F.col("fold") != i), features, make()), df.where(F.col("fold") == i)) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_metrics(df: DataFrame, features: dict[str, list[str]], make: Callable[[], list[Estimator]], k: int) -> DataFrame:
    """``(features, fold, n_pos, n_neg, auc, ap)`` for named feature sets."""
    out = None
    for name, columns in features.items():
        m = rank_metrics(out_of_fold(df, columns, make, k), "score", "y", ["fold"]).withColumn("features", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def residuals(scored: DataFrame) -> DataFrame:
    """Append ``residual``: label less out-of-fold score."""
    return scored.withColumn("residual", F.col("y") - F.col("score"))


def grid(**values: list) -> Iterator[dict]:
    """All combinations of parameters, the last one varying fastest."""
    for x in itertools.product(*values.values()):
        yield dict(zip(values, x, strict=True))


def tuned(df: DataFrame, features: list[str], kind: str, params: list[dict], outer: int, inner: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nested selection: per outer fold the parameters with the best inner mean area (the first of equals), and its area.

    ``inner`` gives the training rows a column ``fold`` of their own.
    """
    spark, rows = df.sparkSession, []
    for i in range(outer):
        train = materialise(inner(df.where(F.col("fold") != i).drop("fold")), "train")
        k = train.agg(F.max("fold")).first()[0] + 1
        best, chosen = -1.0, params[0]
        for p in params:
            value = rank_metrics(out_of_fold(train, features, lambda p=p: reader(kind, **p), k), "score", "y", ["fold"]).agg(F.avg("auc")).first()[0] or 0.0
            if value > best:
                best, chosen = value, p
        test = scores(fit(train, features, reader(kind, **chosen)), df.where(F.col("fold") == i))
        got = rank_metrics(test, "score", "y", []).first()
        rows.append((i, str(chosen), best, got["auc"]))
    return spark.createDataFrame(rows, "fold int, chosen string, inner_auc double, auc double")


def importances(df: DataFrame, features: list[str], make: Callable[[], list[Estimator]], k: int) -> DataFrame:
    """Mean importance of each feature over the folds' forests."""
    parts = [fit(df.where(F.col("fold") != i), features, make()).stages[-1].featureImportances.toArray().tolist() for i in range(k)]
    return df.sparkSession.createDataFrame([(f, float(sum(p[n] for p in parts) / k)) for n, f in enumerate(features)], "feature string, importance double")


def components_of(df: DataFrame, vector: str, k: int) -> DataFrame:
    """The first k principal components of standardised vectors as ``pc`` (array)."""
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("x", array_to_vector(F.col(vector).cast("array<double>")))
    model = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="xs", withMean=True), PCA(k=k, inputCol="xs", outputCol="xp")]).fit(x)
    return model.transform(x).select(*df.columns, vector_to_array("xp").alias("pc"))


def kmeans(df: DataFrame, vector: str, k: int, seeds: list[int]) -> DataFrame:
    """Append ``cluster``: the best of several starts by cost."""
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).persist()
    best = min((KMeans(k=k, seed=s, maxIter=30).fit(x) for s in seeds), key=lambda m: m.summary.trainingCost)
    out = best.transform(x).select(*df.columns, F.col("prediction").cast("bigint").alias("cluster"))
    x.unpersist()
    return out


def mixture_bic(df: DataFrame, vector: str, ks: list[int], seed: int = 42) -> DataFrame:
    """``(k, log_likelihood, bic)`` of Gaussian mixtures."""
    from pyspark.ml.functions import array_to_vector

    import math

    x = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    n, rows = x.count(), []
    for k in ks:
        m = GaussianMixture(k=k, seed=seed, maxIter=30).fit(x)
        d = len(m.gaussians[0].mean)
        p = k - 1 + k * d + k * d * (d + 1) // 2
        rows.append((k, float(m.summary.logLikelihood), float(-2 * m.summary.logLikelihood + p * math.log(n))))
    x.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double")


def transfer(source: DataFrame, target: DataFrame, features: list[str], make: Callable[[], list[Estimator]]) -> DataFrame:
    """Scores of a region's rows by a model fitted on another's."""
    return scores(fit(source, features, make()), target)


def stitched(points: DataFrame, cells: DataFrame, features: list[str], make: Callable[[], list[Estimator]], k: int) -> DataFrame:
    """Scores of all cells, each from the model that has not seen its fold's points; both have ``fold``."""
    parts = [scores(fit(points.where(F.col("fold") != i), features, make()), cells.where(F.col("fold") == i)) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bootstrap_labels(df: DataFrame, key: str, vector: str, k: int, runs: int, share: float, seed: int = 42) -> DataFrame:
    """``(key, run, label)``: labels of all rows from k-means fitted on samples of ``share`` of them, one for each run."""
    from pyspark.ml.functions import array_to_vector

    x = materialise(df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features")), "points")
    out = None
    for r in range(runs):
        model = KMeans(k=k, seed=seed + r, maxIter=20).fit(x.where(F.pmod(F.xxhash64(key, F.lit(seed + r)), F.lit(1000)) < int(1000 * share)))
        labels = model.transform(x).select(key, F.lit(r).alias("run"), F.col("prediction").alias("label"))
        out = labels if out is None else out.union(labels)
    return out
