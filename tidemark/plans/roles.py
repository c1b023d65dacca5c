"""The test tables in the roles that the operators expect, in DataFrames and, word for word, in SQL.

documents -> dated, credited documents; benchmark -> queries with decision times; labels -> judgments; events -> a price panel;
orders and lineitem -> portfolios. The derived columns are fixed functions of the ids, so both sides agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS = ["the", "ation", "ment", "ung", "guidance"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, body, lang, source, available_at, published_at, credibility, tickers, sectors, event_tags, severity."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("text").alias("body"), "lang", "source", "n_chars",
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int))").alias("available_at"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(doc_id - doc_id % 48 as int))").alias("published_at"),
        F.expr("0.5 + cast(substr(source, 4) as int) % 5 / 10.0D").alias("credibility"),
        F.expr("array_distinct(array(concat('T', cast(doc_id % 29 as string)), concat('T', cast(doc_id * 7 % 29 as string))))").alias("tickers"),
        F.expr("if(doc_id % 3 = 0, array(concat('S', cast(doc_id % 11 as string))), cast(array() as array<string>))").alias("sectors"),
        F.expr("array(case doc_id % 4 when 0 then 'guidance' when 1 then 'risk_factors' when 2 then 'dividend' else 'macro' end)").alias("event_tags"),
        F.expr("(doc_id % 10) / 10.0D").alias("severity"),
    )


CORPUS = """corpus AS (
  SELECT doc_id, text AS body, lang, source, n_chars,
    TIMESTAMP '2020-01-01' + to_hours(doc_id) AS available_at, TIMESTAMP '2020-01-01' + to_hours(doc_id - doc_id % 48) AS published_at,
    0.5 + (CAST(substr(source, 4) AS INT) % 5) / 10.0::DOUBLE AS credibility,
    CASE WHEN doc_id % 29 = doc_id * 7 % 29 THEN ['T' || (doc_id % 29)] ELSE ['T' || (doc_id % 29), 'T' || (doc_id * 7 % 29)] END AS tickers,
    CASE WHEN doc_id % 3 = 0 THEN ['S' || (doc_id % 11)] ELSE [] END AS sectors,
    [CASE doc_id % 4 WHEN 0 THEN 'guidance' WHEN 1 THEN 'risk_factors' WHEN 2 THEN 'dividend' ELSE 'macro' END] AS event_tags,
    (doc_id % 10) / 10.0::DOUBLE AS severity
  FROM documents)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query_text, decision_time and weights (ticker -> weight)."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(200 + item_id * 19 as int))").alias("decision_time"),
        F.expr("map_from_arrays(array(concat('T', cast(item_id % 29 as string)), concat('T', cast((item_id + 5) % 29 as string)), concat('T', cast((item_id + 11) % 29 as string))), array(0.5D, -0.3D, 0.2D))").alias("weights"),
    )


DECISIONS = """decisions AS (
  SELECT item_id AS query_id, text AS query_text, TIMESTAMP '2020-01-01' + to_hours(200 + item_id * 19) AS decision_time,
    ['T' || (item_id % 29), 'T' || ((item_id + 5) % 29), 'T' || ((item_id + 11) % 29)] AS holdings, [0.5::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE] AS sizes
  FROM benchmark)"""

TOKENS = r"list_filter(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[A-Za-z][A-Za-z0-9_.$''-]*|\d+(?:\.\d+)?'), lambda t: trim(t, '.$''')), lambda t: t <> '')"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, relevance 0..3): each labelled document judged for the query its id points to."""
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 25).alias("query_id"), "doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).cast("int").alias("relevance"))


JUDGMENTS = "judgments AS (SELECT doc_id % 25 AS query_id, doc_id, 2 * quality + 1 - toxic AS relevance FROM labels)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, query_id, doc_id, rank): two made-up runs over the same queries."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("method"), (F.col("doc_id") % 25).alias("query_id"), "doc_id").selectExpr(
        "method", "query_id", "doc_id", "row_number() over (partition by method, query_id order by (doc_id * if(method = 'm1', 7919, 104729)) % 1009, doc_id) as rank"
    )


RUNS = """runs AS (
  SELECT method, query_id, doc_id, row_number() OVER (PARTITION BY method, query_id ORDER BY (doc_id * CASE method WHEN 'm1' THEN 7919 ELSE 104729 END) % 1009, doc_id) AS rank
  FROM (SELECT unnest(['m1', 'm2']) AS method, doc_id % 25 AS query_id, doc_id FROM documents))"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tic, day_no, date, ret): each ticker's events in order stand for its trading days, from one of four first days."""
    e = table(spark, sf_dir, "events").selectExpr("concat('T', cast(user_id % 29 as string)) as tic", "ts", "event_id", "value")
    return e.selectExpr("tic", "row_number() over (partition by tic order by ts, event_id) as day_no", "value").selectExpr(
        "tic", "day_no", "date_add(date'2010-01-04', cast(day_no * 3 as int)) as date", "value", "(pmod(cast(value * 100 as bigint), 41) - 20) / 1037.0D as ret"
    )


PANEL = """panel AS (
  SELECT tic, day_no, DATE '2010-01-04' + CAST(day_no * 3 AS INT) AS date, value, ((CAST(trunc(value * 100) AS BIGINT) % 41 + 41) % 41 - 20) / 1037.0::DOUBLE AS ret
  FROM (SELECT 'T' || (user_id % 29) AS tic, row_number() OVER (PARTITION BY 'T' || (user_id % 29) ORDER BY ts, event_id) AS day_no, value FROM events))"""
