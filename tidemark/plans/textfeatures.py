"""Queries of text features, macro rules and daily aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import textfeatures as T
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, corpus

#: The corpus has invented words, so words of the lists are put into its texts by id.
_PHRASES = ("strong growth beat", "weak demand, recession risk", "interest rate 4.5% outlook", "crude oil shortage may fall", "dividend buyback", "")
_CASES = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES))
ROWS = f"""rows_ AS (SELECT doc_id, tickers, available_at, source, severity, credibility, event_tags, lower(' ' || coalesce(body, '') || ' ' || CASE doc_id % 6 {_CASES} END || ' ' || array_to_string(event_tags, ' ') || ' risk guidance') AS t FROM corpus)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase after the whole body."""
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % 6 + 1).cast("int"))
    d = corpus(spark, sf_dir).withColumn("body", F.concat_ws(" ", "body", phrase))
    return d.withColumns({"title": F.lit(""), "risk_terms": F.array(F.lit("risk")), "intent": F.lit("guidance"), "source_type": F.lit("news"), "macro_relevance": F.lit(0.0)})


def _count(terms: tuple[str, ...]) -> str:
    parts = []
    for t in terms:
        if " " in t:
            parts.append(f"((length(t) - length(replace(t, '{t}', ''))) // {len(t)})")
        else:
            parts.append(rf"len(regexp_extract_all(t, '(^|[^\pL\pN_]){t}[\pL\pN_]*'))")
    return " + ".join(parts)


FEATURES = f"""{ROWS}, n AS (SELECT *, {', '.join(f'{_count(v)} AS n_{k}' for k, v in T.LEXICONS.items())}, greatest(1, len(regexp_extract_all(t, '[a-zA-Z][a-zA-Z\\-'']+'))) AS words, len(regexp_extract_all(t, '\\b\\d+(?:\\.\\d+)?%?\\b')) AS numbers FROM rows_),
g AS (SELECT *, CAST(event_tags[1] = 'guidance' AS INT) AS signal_earnings_guidance, CAST(event_tags[1] = 'risk_factors' AS INT) AS signal_company_risk,
  {', '.join(f'CAST(n_{w} > 0 AS INT) AS signal_{k}' for k, (w, _) in (T.MACRO_SIGNALS | T.COMPANY_SIGNALS).items())} FROM n),
f AS (SELECT *, round(greatest(-1.0, least(1.0, (n_positive - n_negative) / greatest(n_positive + n_negative, 3)::DOUBLE)), 6) AS sentiment_proxy,
  round(least(1.0, (n_negative + n_uncertainty + 1 + signal_company_risk) / 10.0::DOUBLE), 6) AS risk_intensity, round(least(1.0, (n_positive + n_capital_return) / 8.0::DOUBLE), 6) AS opportunity_intensity,
  round(least(1.0, n_uncertainty / 8.0::DOUBLE), 6) AS uncertainty_intensity, round(least(1.0, (n_forward_looking + 1) / 7.0::DOUBLE), 6) AS forward_looking_intensity,
  round(least(1.0, numbers / greatest(words / 100.0::DOUBLE, 1.0) / 12.0), 6) AS numerical_density,
  round(least(1.0, 0.20::DOUBLE + 0.12 * ({' + '.join(f'signal_{k}' for k in T.MACRO_SIGNALS)}) + 0.10 * ({' + '.join(f'signal_{k}' for k in T.SIGNALS if k not in T.MACRO_SIGNALS)}) + 0.15 * severity), 6) AS action_relevance FROM g)"""
COLUMNS = ["sentiment_proxy", "risk_intensity", "opportunity_intensity", "uncertainty_intensity", "forward_looking_intensity", "numerical_density", "action_relevance"]
_DIRECTION = "CASE WHEN sentiment_proxy >= 0.18 AND risk_intensity < 0.35 THEN 'positive' WHEN sentiment_proxy <= -0.18 OR risk_intensity >= 0.65 THEN 'negative' WHEN abs(sentiment_proxy) < 0.08 AND risk_intensity < 0.30 THEN 'neutral' ELSE 'mixed' END"


def _features(d: DataFrame) -> DataFrame:
    return T.document_features(d).select("doc_id", *COLUMNS, "impact_direction", *[f"signal_{k}" for k in T.SIGNALS])


@query("document_features", f"WITH {CORPUS}, {FEATURES} SELECT doc_id, {', '.join(COLUMNS)}, {_DIRECTION} AS impact_direction, {', '.join(f'signal_{k}' for k in T.SIGNALS)} FROM f")
def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(rows(spark, sf_dir))


MEANS = {"risk_intensity": "avg_risk", "sentiment_proxy": "avg_sentiment", "action_relevance": "avg_relevance"}
SIGNALS = ["signal_macro_rates", "signal_energy", "signal_company_risk"]


def _daily(d: DataFrame) -> DataFrame:
    f = T.by_ticker(T.document_features(d)).withColumns({"final_score": F.col("severity"), "decay_weight_30d": F.expr("doc_id % 97 / 97.0D"), "date": F.to_date("available_at").cast("string")})
    return T.daily_features(f, ["date", "tic"], "stock", MEANS, SIGNALS)


@query("daily_text_features", f"""WITH {CORPUS}, {FEATURES}, e AS (SELECT *, CAST(CAST(available_at AS DATE) AS VARCHAR) AS date, greatest(severity, 0.05) * greatest((doc_id % 97) / 97.0::DOUBLE, 0.01) AS w, unnest(tickers) AS tic FROM f)
SELECT date, tic, count(*) AS stock_doc_count, count(DISTINCT doc_id) AS stock_unique_doc_count, {', '.join(f'round(coalesce(sum({c} * w) / sum(w), 0), 6) AS stock_{n}' for c, n in MEANS.items())}, round(max(severity), 6) AS stock_max_severity,
  {', '.join(f'CAST(sum({s}) AS BIGINT) AS stock_{s}_count' for s in SIGNALS)}, {', '.join(f'max(CAST({s} > 0 AS INT)) AS stock_{s}_flag' for s in SIGNALS)} FROM e GROUP BY ALL""")
def daily_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(rows(spark, sf_dir))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).selectExpr("doc_id % 25 as query_id", "doc_id", "tickers", "severity", "credibility", "round(doc_id * 37 % 101 / 101.0D, 6) as final_score")


RETRIEVED = "ret AS (SELECT doc_id % 25 AS query_id, doc_id, tickers, severity, credibility, round(doc_id * 37 % 101 / 101.0::DOUBLE, 6) AS final_score FROM corpus)"
_AGGS = "count(*) AS n, round(max(final_score), 6) AS top1, round(list_avg(list_sort(list(final_score), 'DESC')[1:5]), 12) AS top5_mean, count_if(severity >= 0.5) AS severe, round(avg(final_score * credibility), 12) AS credible_score"


@query("portfolio_features", f"WITH {CORPUS}, {RETRIEVED} SELECT query_id, {_AGGS} FROM ret GROUP BY query_id")
def portfolio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.retrieval_features(_retrieved(spark, sf_dir), ["query_id"])


@query("ticker_features", f"WITH {CORPUS}, {RETRIEVED}, e AS (SELECT *, unnest(CASE WHEN doc_id % 13 = 0 THEN ['MARKET'] ELSE tickers END) AS tic FROM ret) SELECT query_id, tic, {_AGGS} FROM e GROUP BY ALL")
def ticker_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _retrieved(spark, sf_dir).withColumn("tickers", F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("tickers")))
    return T.retrieval_features(T.by_ticker(d), ["query_id", "tic"])


_SERIES = ("T10Y2Y", "DGS10", "VIXCLS", "BAMLH0A0HYM2", "DCOILWTICO", "CPIAUCSL", "UNRATE", "HOUST", "PAYEMS", "OTHER", "")
_SCALE = (0.001, 0.004, 0.03, 0.006, 0.1, 0.2, 0.007, 1.6, 1.0, 1.0, 1.0)


def _macro_sql() -> str:
    one = lambda row: (*row[:-1], " ".join(row[-1]))
    when = ["WHEN series = '' OR value IS NULL THEN " + repr(one(T.NO_VALUE))]
    for names, test, bound, *row in T.MACRO_RULES:
        when.append(f"WHEN series IN ({', '.join(repr(n) for n in names)})" + (f" AND value {test} {bound}" if test else "") + f" THEN {one(tuple(row))!r}")
    cases = "CASE " + " ".join(when) + f" ELSE {one(T.NO_RULE)!r} END"
    names = ("impact_direction", "risk_intensity", "uncertainty_intensity", "sentiment_proxy", "opportunity_intensity", "action_relevance", "signals")
    for row in map(one, [T.NO_VALUE, T.NO_RULE, *[tuple(r[3:]) for r in T.MACRO_RULES]]):
        packed = "{" + ", ".join(f"'{k}': {v!r}" + ("" if isinstance(v, str) else "::DOUBLE") for k, v in zip(names, row, strict=True)) + "}"
        cases = cases.replace(f"THEN {row!r}", f"THEN {packed}").replace(f"ELSE {row!r}", f"ELSE {packed}")
    series = "[" + ", ".join(repr(s) for s in _SERIES) + "]"
    scale = "[" + ", ".join(f"{x}::DOUBLE" for x in _SCALE) + "]"
    return f"WITH o AS (SELECT event_id, {series}[event_id % 11 + 1] AS series, CASE WHEN event_id % 17 = 0 THEN NULL ELSE round(({scale})[event_id % 11 + 1] * (event_id * 7919 % 1013), 4) - CASE event_id % 11 WHEN 0 THEN 0.5 ELSE 0 END END AS value FROM events), r AS (SELECT event_id, {cases} AS r FROM o) SELECT event_id, {', '.join(f'r.{n} AS {n}' for n in names)} FROM r"


@query("macro_rules", _macro_sql())
def macro_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("event_id") % 11 + 1).cast("int")
    value = F.round(F.element_at(F.array(*map(F.lit, map(float, _SCALE))), i) * (F.col("event_id") * 7919 % 1013), 4) - F.when(F.col("event_id") % 11 == 0, 0.5).otherwise(0.0)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.element_at(F.array(*map(F.lit, _SERIES)), i).alias("series"), F.when(F.col("event_id") % 17 != 0, value).alias("value"))
    return e.select("event_id", T.macro_rules(F.col("series"), F.col("value")).alias("r")).select("event_id", "r.*")


@query("macro_parse", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'UNRATE' WHEN 1 THEN 'VIXCLS' ELSE 'DGS10' END AS series, round(doc_id / 8.0, 3) AS value FROM documents")
def macro_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.format_string("%.3f", F.col("doc_id") / 8.0)
    d = corpus(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, " unrate ").alias("explicit"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Series VIXCLS : Value: "), number)).otherwise(F.concat(F.lit("Value: +"), number)).alias("said"))
    return d.select("doc_id", T.macro_series(F.col("explicit"), F.col("said"), F.lit("official_macro_dgs10_2020-01-01")).alias("series"), T.macro_value(F.lit(None).cast("string"), F.col("said")).alias("value"))


@query("source_quality", f"WITH {CORPUS} SELECT source, lang, count(*) AS docs, round(avg(credibility), 6) AS mean_credibility, count_if(doc_id % 2 = 0) AS with_features, round(avg(CASE WHEN doc_id % 2 = 0 THEN severity ELSE 0 END), 6) AS mean_signal, round(0.65 * avg(CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1 END) + 0.25 * avg(CASE WHEN available_at <= TIMESTAMP '2020-01-20' THEN 1 ELSE 0 END) + 0.10 * least(count(*) / 100.0, 1), 6) AS integrity FROM corpus GROUP BY ALL")
def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).withColumns({"has": F.col("doc_id") % 2 == 0, "complete": F.when(F.col("doc_id") % 5 == 0, 0.5).otherwise(1.0), "in_time": (F.col("available_at") <= F.lit("2020-01-20").cast("timestamp_ntz")).cast("int")})
    integrity = 0.65 * F.avg("complete") + 0.25 * F.avg("in_time") + 0.10 * F.least(F.count("*") / 100.0, F.lit(1.0))
    return d.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.round(F.avg("credibility"), 6).alias("mean_credibility"), F.count_if("has").alias("with_features"), F.round(F.avg(F.when(F.col("has"), F.col("severity")).otherwise(0.0)), 6).alias("mean_signal"), F.round(integrity, 6).alias("integrity"))


@query("ticker_coverage", f"WITH {CORPUS}, e AS (SELECT unnest(tickers) AS tic, doc_id, severity FROM corpus) SELECT tic, count(DISTINCT doc_id) AS docs, count_if(doc_id % 2 = 0) AS with_features, round(avg(CASE WHEN doc_id % 2 = 0 THEN severity END), 6) AS mean_score FROM e GROUP BY tic")
def ticker_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.by_ticker(corpus(spark, sf_dir).select("tickers", "doc_id", "severity"))
    has = F.col("doc_id") % 2 == 0
    return e.groupBy("tic").agg(F.count_distinct("doc_id").alias("docs"), F.count_if(has).alias("with_features"), F.round(F.avg(F.when(has, F.col("severity"))), 6).alias("mean_score"))


@query("corpus_summary", f"WITH {CORPUS} SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS docs, count_if(severity >= 0.5) AS severe, min(available_at) AS oldest, max(available_at) AS newest FROM corpus GROUP BY GROUPING SETS ((source), (lang), ())")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).groupingSets([["source"], ["lang"], []], "source", "lang")
    out = d.agg(F.count("*").alias("docs"), F.count_if(F.col("severity") >= 0.5).alias("severe"), F.min("available_at").alias("oldest"), F.max("available_at").alias("newest"))
    return out.withColumns({"source": F.coalesce("source", F.lit("all")), "lang": F.coalesce("lang", F.lit("all"))})
