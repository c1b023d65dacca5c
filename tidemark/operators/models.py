"""Linear models of panel targets, and the fit of reranking weights."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evaluation import gain, ideal_gains


def scaled(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Medians for missing values, means and population deviations, all of the training rows alone; a column `x` of vectors."""
    filled = [f"{f}__" for f in features]
    imputer = Imputer(strategy="median", inputCols=features, outputCols=filled).fit(train)
    train, test = imputer.transform(train), imputer.transform(test)
    stats = train.agg(*[F.avg(f).alias(f"{f}m") for f in filled], *[F.stddev_pop(f).alias(f"{f}s") for f in filled]).first()
    scale = lambda df: df.withColumns({f: (F.col(f) - stats[f"{f}m"]) / (stats[f"{f}s"] or 1.0) for f in filled})
    put = VectorAssembler(inputCols=filled, outputCol="x")
    return put.transform(scale(train)), put.transform(scale(test))


def logistic(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """test with p, the chance of label 1; classes weigh the same, and the penalty is one over the number of rows."""
    train, test = scaled(train, test, features)
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    for k, v in counts.items():
        weight = F.when(F.col(label) == k, n / (len(counts) * v)).otherwise(weight)
    model = LogisticRegression(featuresCol="x", labelCol=label, weightCol="w", regParam=1.0 / n, standardization=False, maxIter=200).fit(train.withColumn("w", weight))
    return model.transform(test).withColumn("p", F.element_at(vector_to_array(F.col("probability")), 2))


def ridge(train: DataFrame, test: DataFrame, features: list[str], label: str, alpha: float = 10.0) -> DataFrame:
    """test with prediction, by least squares with a penalty of alpha on squared weights, intercept apart.

    One aggregate gives the sums of products, of which there are as many as pairs of features; the driver solves for the weights. (The
    library's own fit divides the penalty by the label's deviation.)
    """
    train, test = scaled(train, test, features)
    x = [F.col(f"{f}__") for f in features]
    n = len(x)
    row = train.agg(F.avg(label).alias("mean"), *[F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)], *[F.sum(a * F.col(label)).alias(f"y{i}") for i, a in enumerate(x)], *[F.sum(a).alias(f"s{i}") for i, a in enumerate(x)]).first()
    products = np.array([[row[f"p{i}_{j}"] for j in range(n)] for i in range(n)])
    weights = np.linalg.solve(products + alpha * np.eye(n), [row[f"y{i}"] - row["mean"] * row[f"s{i}"] for i in range(n)])
    return test.withColumn("prediction", sum((F.lit(float(w)) * c for w, c in zip(weights, x, strict=True)), F.lit(row["mean"])))


def scale_by_query(items: DataFrame, features: list[str]) -> DataFrame:
    """Features as shares of the largest size in their query."""
    w = Window.partitionBy("query_id")
    most = lambda f: F.max(F.abs(f)).over(w)
    return items.withColumns({f: F.col(f) / F.when(most(f) > 0, most(f)).otherwise(1.0) for f in features})


def objective(items: DataFrame, qrels: DataFrame, trials: list[dict[str, float]], k: int = 10, precision: float = 0.0) -> list[float]:
    """Mean NDCG (plus `precision` times precision) of each trial's weights, all in one job: a row gives one score for each trial."""
    score = lambda t: sum((F.lit(v) * F.col(f) for f, v in t.items()), F.lit(0.0))
    rows = items.select("query_id", "doc_id", "rank", "relevance", F.posexplode(F.array(*[F.round(score(t), 12) for t in trials])).alias("trial", "score"))
    w = Window.partitionBy("trial", "query_id").orderBy(F.desc("score"), F.asc("rank"), F.desc("doc_id"))
    rows = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    got = rows.groupBy("trial", "query_id").agg(F.sum(gain(F.coalesce("relevance", F.lit(0)), F.col("place"))).alias("dcg"), (F.count_if(F.col("relevance") > 0) / k).alias("p"))
    got = got.join(ideal_gains(qrels, k), "query_id", "left")
    value = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0) + precision * F.col("p")
    return [r.v for r in got.groupBy("trial").agg(F.avg(value).alias("v")).orderBy("trial").collect()]


def fit_weights(items: DataFrame, qrels: DataFrame, start: dict[str, float], grid: tuple[float, ...], passes: int = 2, precision: float = 0.0) -> dict[str, float]:
    """Coordinate descent on a grid: each weight in turn takes the first value that is strictly better than all before it."""
    weights = dict(start)
    for _ in range(passes):
        changed = False
        for name in weights:
            values = objective(items, qrels, [weights, *[weights | {name: g} for g in grid]], precision=precision)
            best, value = values[0], weights[name]
            for g, v in zip(grid, values[1:], strict=True):
                if v > best + 1e-12:
                    best, value = v, g
            changed |= value != weights[name]
            weights[name] = value
        if not changed:
            break
    return weights


def cross_validate(items: DataFrame, qrels: DataFrame, folds: DataFrame, start: dict[str, float], grid: tuple[float, ...], passes: int = 1) -> list[float]:
    """Objective of each fold's queries under weights fitted on the others."""
    tagged, judged = items.join(folds, "query_id"), qrels.join(folds, "query_id")
    out = []
    for f in sorted(r.fold for r in folds.select("fold").distinct().collect()):
        w = fit_weights(tagged.filter(F.col("fold") != f), judged.filter(F.col("fold") != f), start, grid, passes)
        out.append(objective(tagged.filter(F.col("fold") == f), judged.filter(F.col("fold") == f), [w])[0])
    return out
