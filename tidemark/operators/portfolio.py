"""Portfolios: weights, concentration, signals; cards and regime of a macro snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holdings_value(rows: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Weight of each holding in its portfolio's value; rows without a positive price and quantity are left out."""
    rows = rows.filter((F.col("price") > 0) & (F.col("quantity") > 0)).withColumn("value", F.col("price") * F.col("quantity"))
    return rows.withColumn("weight", F.col("value") / F.sum("value").over(Window.partitionBy(key)))


def concentration(top1: Column, top2: Column) -> Column:
    return F.when((top1 >= 0.30) | (top2 >= 0.50), "high").when(top1 >= 0.20, "moderate").otherwise("balanced")


def summary(rows: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Value, number of holdings, the largest weights, dominant sector (alphabetically first of equals) and concentration."""
    rows = holdings_value(rows, key)
    sectors = rows.groupBy(key, "sector").agg(F.sum("weight").alias("w")).groupBy(key).agg(F.min_by("sector", F.struct(-F.round("w", 9), "sector")).alias("dominant_sector"), F.max("w").alias("sector_weight"))
    weights = F.sort_array(F.collect_list("weight"), asc=False)
    out = rows.groupBy(key).agg(F.sum("value").alias("value"), F.count("*").alias("holdings"), F.get(weights, F.lit(0)).alias("top1"), (F.get(weights, F.lit(0)) + F.coalesce(F.get(weights, F.lit(1)), F.lit(0.0))).alias("top2"))
    return out.join(sectors, key).withColumn("concentration", concentration(F.round("top1", 9), F.round("top2", 9)))


def sector_slices(rows: DataFrame, key: str = "portfolio_id", most: int = 6, shown: int = 5) -> DataFrame:
    """Sector weights for a chart: with more than `most` sectors the first `shown` and Other."""
    w = holdings_value(rows, key).groupBy(key, "sector").agg(F.sum("weight").alias("weight")).filter("weight > 0")
    place = Window.partitionBy(key)
    w = w.withColumns({"place": F.row_number().over(place.orderBy(F.desc(F.round("weight", 9)), "sector")), "n": F.count("*").over(place)})
    name = F.when((F.col("n") > most) & (F.col("place") > shown), "Other").otherwise(F.col("sector"))
    return w.groupBy(key, name.alias("slice")).agg(F.sum("weight").alias("weight"))


def tone(score: Column) -> Column:
    return F.when(score >= 0.35, "positive").when(score <= -0.35, "negative").otherwise("neutral")


def regime(tones: list[Column]) -> Column:
    """risk_on or risk_off if at least two more cards say so than say the opposite."""
    votes = sum((F.when(t == "positive", 1).when(t == "negative", -1).otherwise(0) for t in tones), F.lit(0))
    return F.when(votes >= 2, "risk_on").when(votes <= -2, "risk_off").otherwise("transition")


def real_yield(explicit: Column, nominal: Column, breakeven: Column) -> Column:
    return F.coalesce(explicit, nominal - breakeven)


def signal_strength(f: dict[str, Column], active: Column) -> Column:
    """Composite of a document's mean features and the number of its active signals."""
    weights = {"relevance": 0.85, "severity": 0.65, "risk": 0.45, "uncertainty": 0.35, "opportunity": 0.40, "forward": 0.30, "final": 0.25}
    return sum((w * f[k] for k, w in weights.items()), F.lit(0.0)) + 0.30 * F.abs(f["sentiment"]) + 0.25 * F.least(F.lit(1.0), active / 6)


def impact(direction: Column) -> Column:
    return F.when(direction == "positive", 1.0).when(direction == "negative", -1.0).when(direction == "mixed", 0.25).otherwise(0.0)


def disagreement(f: dict[str, Column]) -> Column:
    """How far a prediction is from its teacher; errors count 1 at most."""
    error = lambda k: F.least(F.lit(1.0), F.abs(f[k]))
    return 2.0 * f["direction_differs"] + 1.75 * (1 - f["f1"]) + 0.12 * f["wrong_signals"] + 1.0 * error("action") + 0.7 * error("risk") + 0.45 * error("uncertainty") + 0.25 * error("sentiment")
