"""Streaming extensions: first copy of a document wins, daily counts with late rows, context as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_copies(stream: DataFrame, key: str = "document_hash", when: str = "available_at", late: str = "7 days") -> DataFrame:
    """Each key once; state of a key goes when it can't come again in time."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, by: str, value: str, when: str = "available_at", late: str = "1 day") -> DataFrame:
    """Count and mean by day and group; a day is final once the watermark has passed it."""
    day = F.window(when, "1 day")
    return stream.withWatermark(when, late).groupBy(day, by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("day"), by, "n", "mean")


def with_decisions(stream: DataFrame, decisions: DataFrame, days: int) -> DataFrame:
    """Arriving documents with the stored decisions they are in time for, by blocks of days as in batch."""
    block = lambda t: F.floor(F.unix_date(F.to_date(t)) / days)
    right = decisions.withColumn("block", F.explode(F.array(block(F.col("decision_time")), block(F.col("decision_time")) - 1)))
    inside = (F.col("available_at") <= F.col("decision_time")) & (F.col("available_at") >= F.col("decision_time") - F.make_dt_interval(F.lit(days)))
    return stream.withColumn("block", block(F.col("available_at"))).join(right, "block").filter(inside).drop("block")
