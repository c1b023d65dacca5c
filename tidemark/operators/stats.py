"""Rank statistics with ties, by groups, without collecting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rank from 1, equal values sharing the mean of their ranks: values are counted first, so the window sees each once."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(*by, value, (before + (F.col("n_") + 1) / 2).alias(name))
    return rows.join(ranks, [*by, value])


def spearman(rows: DataFrame, by: list[str], x: str, y: str, least: int = 50) -> DataFrame:
    """Null with fewer rows than `least`, or if a side doesn't vary; rows with a missing side are left out."""
    rows = rows.select(*by, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(rows, by, x, "rx"), by, y, "ry")
    varies = (F.count("*") >= least) & (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(varies, F.corr("rx", "ry")).alias("spearman"))


def auc(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Area under the curve by rank sums; null with one class only."""
    ranked = average_rank(rows.select(*by, label, score).filter(F.col(score).isNotNull()), by, score, "r")
    n1, n0 = F.sum(label), F.sum(1 - F.col(label))
    area = (F.sum(F.col("r") * F.col(label)) - n1 * (n1 + 1) / 2) / (n1 * n0)
    return ranked.groupBy(*by).agg(F.when((n1 > 0) & (n0 > 0), area).alias("auc"))


def average_precision(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Precision at each distinct score, weighted by the recall it adds."""
    at = rows.groupBy(*by, score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("precision", F.sum("p").over(w) / F.sum("n").over(w))
    return at.groupBy(*by).agg(F.when(F.sum("p") > 0, F.sum(F.col("precision") * F.col("p")) / F.sum("p")).alias("average_precision"))


def correlation(x: str, y: str) -> Column:
    """Pearson's, null with fewer than three rows or without spread."""
    enough = (F.count(F.col(x) + F.col(y)) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(enough, F.corr(x, y))


def target_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    q = F.percentile(value, [0.05, 0.25, 0.5, 0.75, 0.95])
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q")).select(*by, "n", "mean", "std", *[F.get("q", F.lit(i)).alias(f"q{p:02d}") for i, p in enumerate((5, 25, 50, 75, 95))])


def quality_counts(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row: rows, rows whose key isn't unique, and missing and infinite values of each column."""
    keyed = rows.groupBy(*keys).agg(F.count("*").alias("n_"), *[F.sum(F.col(c).isNull().cast("int")).alias(f"{c}_missing") for c in columns], *[F.sum((F.abs(F.col(c)) == float("inf")).cast("int")).alias(f"{c}_infinite") for c in columns])
    return keyed.agg(F.sum("n_").alias("rows"), F.coalesce(F.sum(F.col("n_") - 1), F.lit(0)).alias("duplicate_rows"), *[F.coalesce(F.sum(f"{c}_{k}"), F.lit(0)).alias(f"{c}_{k}") for c in columns for k in ("missing", "infinite")])


def redundant(correlations: dict[tuple[str, str], float], names: list[str], most: float = 0.95) -> list[str]:
    """Names in order, without those that correlate by `most` or more with one that is kept; for a table of columns' correlations."""
    kept: list[str] = []
    for n in names:
        if all(abs(correlations.get((n, k), correlations.get((k, n), 0.0))) < most for k in kept):
            kept.append(n)
    return kept
