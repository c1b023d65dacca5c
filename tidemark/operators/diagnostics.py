"""Relations of features and targets, screening of runs, numbers and sentences of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import auc, spearman


def long_form(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, x): a row for each feature of each row, so one plan serves all features."""
    return rows.unpivot(keys, [F.col(f).cast("double").alias(f) for f in features], "feature", "x")


def relations(rows: DataFrame, features: list[str], target: str, flag: str, least: int = 50) -> DataFrame:
    """Of each feature on the rows: Spearman with the target, AUC for the flag, deviation, share of non-zero values, screen score."""
    long = long_form(rows, [target, flag], features)
    rho = spearman(long, ["feature"], "x", target, least).select("feature", "spearman")
    area = auc(long.filter(F.col(flag).isNotNull()), ["feature"], flag, "x")
    spread = long.groupBy("feature").agg(F.stddev_pop("x").alias("std"), F.avg((F.col("x") != 0).cast("int")).alias("nonzero"))
    out = spread.join(rho, "feature", "left").join(area, "feature", "left")
    return out.withColumn("screen", F.coalesce(F.abs("spearman"), F.lit(0.0)) + 2 * F.coalesce(F.abs(F.col("auc") - 0.5), F.lit(0.0)))


def fold_edges(rows: DataFrame, features: list[str], flag: str, fold: str) -> DataFrame:
    """Edge of each feature (AUC less a half) over folds: its mean, and the share of folds that agree with the mean's sign."""
    edges = auc(long_form(rows, [flag, fold], features), ["feature", fold], flag, "x").filter("auc IS NOT NULL").withColumn("edge", F.col("auc") - 0.5)
    mean = edges.withColumn("mean_edge", F.avg("edge").over(Window.partitionBy("feature")))
    return mean.groupBy("feature").agg(F.first("mean_edge").alias("mean_edge"), F.avg((F.signum("edge") == F.signum("mean_edge")).cast("int")).alias("stability"), F.count("*").alias("folds"))


def stable_score(edge: Column, stability: Column, weight: Column) -> Column:
    return F.abs(edge) * weight * F.greatest(stability, F.lit(0.25))


def recommended(rows: DataFrame, root: Column, limit: int) -> DataFrame:
    """The best rows by train_edge + 0.5 test_edge + 0.02 min(coef, 10), one of each root; weak and shifting ones are left out."""
    good = ((F.col("train_edge") >= 0.015) | (F.col("coef") >= 0.05)) & (F.abs("rate_change") <= 0.25)
    score = F.col("train_edge") + 0.5 * F.col("test_edge") + 0.02 * F.least(F.col("coef"), F.lit(10.0))
    best = rows.filter(good).withColumns({"root": root, "recommend": score})
    best = best.withColumn("own", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("recommend"), "feature"))).filter("own = 1")
    return best.orderBy(F.desc("recommend"), "feature").limit(limit).drop("own")


def deltas(rows: DataFrame, by: list[str], variant: str, base: str, measures: list[str]) -> DataFrame:
    """Each measure less that of the base variant in its group."""
    w = Window.partitionBy(*by)
    own = lambda m: F.max(F.when(F.col(variant) == base, F.col(m))).over(w)
    return rows.withColumns({f"{m}_delta": F.col(m) - own(m) for m in measures})


def passes_gate(rows: DataFrame, base: str, variant: str = "experiment") -> DataFrame:
    """gate: better Sharpe and return than the base, drawdown at most 0.03 deeper, turnover at most a quarter more."""
    w = Window.partitionBy()
    own = lambda m: F.max(F.when(F.col(variant) == base, F.col(m))).over(w)  # noqa: E731  a row for each experiment
    gate = (F.col("sharpe") > own("sharpe")) & (F.col("cumulative") > own("cumulative")) & (F.abs("max_drawdown") <= F.abs(own("max_drawdown")) + 0.03) & (F.col("turnover") <= 1.25 * own("turnover"))
    return rows.withColumn("gate", gate & (F.col(variant) != base))


def metric_pair(text: Column, label: str) -> tuple[Column, Column]:
    """The two numbers that follow a label: this period and the one before; null where there aren't two."""
    number = r"(\(?-?\$?\s?\d[\d,]*(?:\.\d+)?\)?)"
    pattern = rf"(?i){label}[^\d\n(-]{{0,40}}{number}\s+{number}"
    read = lambda i: F.regexp_extract(text, pattern, i)
    value = lambda x: F.when(x.startswith("("), -F.regexp_replace(x, r"[^0-9.]", "").try_cast("double")).otherwise(F.regexp_replace(x, r"[^0-9.-]", "").try_cast("double"))
    return value(read(1)), value(read(2))


def snapshot(rows: DataFrame, text: str, labels: dict[str, str]) -> DataFrame:
    """For each label its two numbers and the change in percent, and margins of revenue."""
    out = rows
    for name, label in labels.items():
        now, before = metric_pair(F.col(text), label)
        out = out.withColumns({name: now, f"{name}_prior": before})
        out = out.withColumn(f"{name}_change", F.when(F.col(f"{name}_prior") != 0, F.round((F.col(name) - F.col(f"{name}_prior")) / F.abs(f"{name}_prior") * 100, 2)))
    return out


def sentences(text: Column, least: int, most: int) -> Column:
    """The first `most` sentences of `least` characters or more, as the feature's list is."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: F.length(s) >= least), 1, most)


def between(text: Column, start: str, end: str) -> Column:
    """What stands between two markers, to the text's end without the second; empty without the first."""
    at = F.locate(start, text)
    rest = F.substring(text, at + len(start), F.length(text))
    stop = F.locate(end, rest)
    return F.when(at == 0, "").otherwise(F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(rest))


def compact(value: Column) -> Column:
    """A number as charts write it: 1.2B, 3.4M, 5.6K."""
    size = F.abs(value)
    scaled = lambda by, unit: F.concat(F.format_string("%.1f", value / by), F.lit(unit))
    return F.when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K")).otherwise(F.format_string("%.2f", value))
