"""Queries of packages, filings, models, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import filings
from tidemark.operators import handoff as H
from tidemark.operators import models as M
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, JUDGMENTS, RUNS, corpus, judgments, runs, table
from tidemark.sources import files
from tidemark.streaming import documents as live

CONTEXTS = f"""{CORPUS}, {RUNS}, ctx AS (SELECT method, query_id, doc_id, rank, substr(body, 1, doc_id % 4 * 20) AS body_excerpt, sha256(body) AS document_hash, available_at,
  CASE WHEN doc_id % 31 = 0 THEN NULL ELSE published_at + to_hours(doc_id % 60) END AS published_at, TIMESTAMP '2020-01-25' AS decision_time, TIMESTAMP '2020-01-25' + to_hours(doc_id % 5 - 3) AS retrieval_cutoff,
  CASE WHEN len(sectors) > 0 THEN 'sector' WHEN doc_id % 2 = 0 THEN 'stock' ELSE 'market' END AS evidence_scope, severity AS final_score, sha256(body) AS cluster, tickers AS matched_tickers FROM runs JOIN corpus USING (doc_id) WHERE rank <= 12
  UNION ALL BY NAME SELECT method, query_id, doc_id, 0 AS rank, body AS body_excerpt, sha256(body) AS document_hash, available_at, published_at, TIMESTAMP '2020-01-25' AS decision_time, TIMESTAMP '2020-01-25' AS retrieval_cutoff, 'market' AS evidence_scope, severity AS final_score, sha256(body) AS cluster, tickers AS matched_tickers FROM runs JOIN corpus USING (doc_id) WHERE rank = 1)"""


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).join(corpus(spark, sf_dir), "doc_id").withColumns({"document_hash": F.sha2("body", 256), "cluster": F.sha2("body", 256), "decision_time": F.lit("2020-01-25").cast("timestamp_ntz"), "final_score": F.col("severity"), "matched_tickers": F.col("tickers")})
    hours = lambda x: F.make_dt_interval(F.lit(0), x.cast("int"))
    scope = F.when(F.size("sectors") > 0, "sector").when(F.col("doc_id") % 2 == 0, "stock").otherwise("market")
    first = rows.filter("rank <= 12").withColumns({"body_excerpt": F.substring("body", F.lit(1), (F.col("doc_id") % 4 * 20).cast("int")), "published_at": F.when(F.col("doc_id") % 31 != 0, F.col("published_at") + hours(F.col("doc_id") % 60)), "retrieval_cutoff": F.col("decision_time") + hours(F.col("doc_id") % 5 - 3), "evidence_scope": scope})
    again = rows.filter("rank = 1").withColumns({"rank": F.lit(0), "body_excerpt": F.col("body"), "retrieval_cutoff": F.col("decision_time"), "evidence_scope": F.lit("market")})
    names = ["method", "query_id", "doc_id", "rank", "body_excerpt", "document_hash", "available_at", "published_at", "decision_time", "retrieval_cutoff", "evidence_scope", "final_score", "cluster", "matched_tickers"]
    return first.select(*names).unionByName(again.select(*names))


_TIMED = "decision_time IS NOT NULL AND retrieval_cutoff IS NOT NULL AND published_at IS NOT NULL AND available_at IS NOT NULL"
_TESTS = {"empty_body_excerpt": "trim(body_excerpt) = ''", "invalid_timestamp": f"NOT ({_TIMED})"} | {
    k: f"{_TIMED} AND {v}" for k, v in {"available_after_decision": "available_at > decision_time", "available_after_cutoff": "available_at > retrieval_cutoff", "cutoff_after_decision": "retrieval_cutoff > decision_time", "available_before_published": "available_at < published_at", "invalid_rank": "rank < 1", "duplicate_context_row": "again > 1"}.items()
}
ISSUES = f"{CONTEXTS}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, method, doc_id ORDER BY rank) AS again FROM ctx), iss AS (" + " UNION ALL ".join(f"SELECT query_id, method, doc_id, '{k}' AS issue FROM a WHERE {v}" for k, v in _TESTS.items()) + ")"


@query("handoff_validation", f"WITH {ISSUES} SELECT * FROM iss")
def handoff_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.issues(contexts(spark, sf_dir))


@query("handoff_report", f"WITH {ISSUES} SELECT count(*) AS row_count, count(DISTINCT doc_id) AS unique_docs, count(DISTINCT query_id) AS queries, count_if(evidence_scope = 'stock') AS stock_rows, round(min(final_score), 6) AS score_min, round(max(final_score), 6) AS score_max, (SELECT count(*) FROM iss) AS issue_count, CASE WHEN (SELECT count(*) FROM iss) = 0 THEN 'passed' ELSE 'failed' END AS status FROM ctx")
def handoff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.report(contexts(spark, sf_dir))


@query("evidence_bundles", f"""WITH {CONTEXTS} SELECT query_id || ':' || method AS evidence_bundle_id, count(*) AS document_count, count(DISTINCT cluster) AS unique_clusters, array_to_string(list_sort(list_distinct(flatten(list(matched_tickers)))), '|') AS covered_holdings,
  string_agg(doc_id, '|' ORDER BY rank, doc_id) AS documents, {', '.join(f"count_if(evidence_scope = '{s}') AS {s}_count" for s in ('stock', 'sector', 'market'))} FROM ctx GROUP BY query_id, method""")
def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = H.bundles(contexts(spark, sf_dir))
    return b.select("evidence_bundle_id", "document_count", "unique_clusters", F.array_join("covered_holdings", "|").alias("covered_holdings"), F.array_join(F.transform("portfolio_evidence", lambda x: x["doc_id"].cast("string")), "|").alias("documents"), *[F.size(f"{s}_evidence").cast("long").alias(f"{s}_count") for s in ("stock", "sector", "market")])


@query("smoke_differences", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id + 1000000, 'unexpected' FROM labels WHERE doc_id % 10 = 0")
def smoke_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "labels").select("doc_id")
    return H.missing_outputs(corpus(spark, sf_dir), made.union(made.filter("doc_id % 10 = 0").selectExpr("doc_id + 1000000")), "doc_id")


@query("prediction_parse", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 0.0 ELSE least(1.0, greatest(-1.0, doc_id % 7 - 3))::DOUBLE END AS sentiment, CASE WHEN doc_id % 5 = 4 THEN 0.0 ELSE 0.25 END::DOUBLE AS risk, CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'credit|rates' END AS signals, CASE WHEN doc_id % 5 = 4 THEN 'neutral' ELSE 'mixed' END AS direction FROM documents")
def prediction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string('```json\n{"sentiment": %d, "risk": 0.25, "signals": ["rates", "made_up", "credit"], "direction": "mixed"}\n```', F.col("doc_id") % 7 - 3)
    p = H.prediction(F.when(F.col("doc_id") % 5 == 4, "I can't say.").otherwise(body))
    return corpus(spark, sf_dir).select("doc_id", p.alias("p")).select("doc_id", "p.sentiment", "p.risk", F.array_join("p.signals", "|").alias("signals"), "p.direction")


@query("html_text", r"""WITH a AS (SELECT page_id, regexp_replace(html, '<(script|style)\b.*?</(script|style)>', ' ', 'gis') AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<br\s*/?>|</(?:div|p|tr|td|th|table|section|article|h[1-6])>', chr(10), 'gis'), '<[^>]+>', ' ', 'gis') AS t FROM a),
c AS (SELECT page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{A0}]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM b) SELECT page_id, array_to_string(lines, chr(10)) AS text, len(lines) AS n_lines FROM c""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "pages").select("page_id", filings.html_lines(F.col("html")).alias("text"))
    return lines.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))


@query("section_extract")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text, whatever its length, stands in a filing with a table of contents; a filing without sections gives its full_filing row."""
    return _sections(corpus(spark, sf_dir), F.coalesce("body", F.lit("")))


def _sections(d: DataFrame, body: Column) -> DataFrame:
    filing = F.concat(F.lit("Contents\nItem 1A. Risk Factors 4\nItem 7. Discussion 9\nItem 1A. Risk Factors\n"), body, F.lit("\nItem 7. Discussion\n"), body)
    out = filings.explode_sections(d.select("doc_id", filing.alias("text"), F.lit("10-K").alias("form")))
    return out.select("doc_id", "section_id", "item_code", F.length("body").cast("long").alias("n_chars"))


#: Days of a series that events stand for.
_DAYS = 3000


@query("macro_documents", f"SELECT 'official_macro_' || CASE WHEN event_id < {_DAYS} THEN 'unrate' ELSE 'series' || (event_id // {_DAYS}) END || '_' || CAST(DATE '2020-01-01' + CAST(event_id % {_DAYS} AS INT) AS VARCHAR) AS doc_id, CAST(DATE '2020-01-01' + CAST(event_id % {_DAYS} + 5 AS INT) AS VARCHAR) || ' 14:00:00' AS available_at FROM events WHERE value IS NOT NULL")
def macro_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an observation: _DAYS days of UNRATE, then as many of each further series."""
    return _macro(table(spark, sf_dir, "events"))


def _macro(events: DataFrame) -> DataFrame:
    number, day = F.floor(F.col("event_id") / _DAYS), F.pmod("event_id", F.lit(_DAYS)).cast("int")
    series = F.when(number == 0, "UNRATE").otherwise(F.concat(F.lit("SERIES"), number.cast("string")))
    obs = events.select(series.alias("series"), F.date_add(F.lit("2020-01-01").cast("date"), day).alias("day"), "value")
    return files.macro_documents(obs, 5).select("doc_id", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"))


@query("date_universe", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, string_agg(DISTINCT 'T' || (user_id % 29), '|' ORDER BY 'T' || (user_id % 29)) AS tickers FROM events GROUP BY 1")
def date_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.concat(F.lit("T"), (F.col("user_id") % 29).cast("string")).alias("tic"))
    return files.universe(p).select(F.col("date").cast("string").alias("date"), F.array_join("tickers", "|").alias("tickers"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).filter("method = 'm1' AND rank <= 20").join(judgments(spark, sf_dir), ["query_id", "doc_id"], "left").join(corpus(spark, sf_dir).select("doc_id", "severity", "credibility"), "doc_id")
    return M.scale_by_query(r.withColumn("base", 1 / F.col("rank")), ["base", "severity"])


_START, _GRID = {"base": 1.0, "severity": 0.0, "credibility": 0.0}, (0.0, 0.5, 1.0)


@query("reranker_objective", f"""WITH {CORPUS}, {RUNS}, {JUDGMENTS}, i AS (SELECT r.query_id, r.doc_id, rank, coalesce(relevance, 0) AS rel, (1.0 / rank) / max(1.0 / rank) OVER w AS base, CASE WHEN max(severity) OVER w > 0 THEN severity / max(severity) OVER w ELSE severity END AS sev FROM runs r JOIN corpus USING (doc_id) LEFT JOIN judgments j ON j.query_id = r.query_id AND j.doc_id = r.doc_id WHERE method = 'm1' AND rank <= 20 WINDOW w AS (PARTITION BY r.query_id)),
t AS (SELECT * FROM (VALUES (0, 1.0, 0.0), (1, 0.5, 0.5)) AS t(trial, a, b)), p AS (SELECT trial, query_id, rel, row_number() OVER (PARTITION BY trial, query_id ORDER BY round(a * base + b * sev, 12) DESC, rank, doc_id DESC) AS place FROM i, t),
d AS (SELECT trial, query_id, sum((2.0 ** rel - 1) / log2(place + 1)) AS dcg FROM p WHERE place <= 10 GROUP BY ALL), n AS (SELECT query_id, sum((2.0 ** relevance - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM judgments) WHERE place <= 10 GROUP BY query_id)
SELECT trial, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 8) AS objective FROM d LEFT JOIN n USING (query_id) GROUP BY trial""")
def reranker_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = M.objective(_items(spark, sf_dir), judgments(spark, sf_dir), [{"base": 1.0, "severity": 0.0}, {"base": 0.5, "severity": 0.5}])
    return spark.createDataFrame([(i, round(v, 8)) for i, v in enumerate(values)], "trial int, objective double")


@query("reranker_fit")
def reranker_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(M.fit_weights(_items(spark, sf_dir), judgments(spark, sf_dir), _START, _GRID, 1).items()), "feature string, weight double")


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    punct = F.length("body") - F.length(F.translate("body", "!|#$%*&", ""))
    return d.select("doc_id", F.col("quality").cast("double").alias("y"), F.log1p("n_chars").alias("size"), (punct / F.col("n_chars")).alias("odd"), F.when(F.col("doc_id") % 9 > 0, F.col("severity")).alias("severity"))


@query("risk_classifier")
def risk_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    return M.logistic(rows.filter("doc_id % 3 <> 0"), rows.filter("doc_id % 3 = 0"), ["size", "odd", "severity"], "y").select("doc_id", "y", F.round("p", 4).alias("p"))


@query("volatility_ridge")
def volatility_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    return M.ridge(rows.filter("doc_id % 3 <> 0"), rows.filter("doc_id % 3 = 0"), ["odd", "severity"], "size").select("doc_id", "size", F.round("prediction", 4).alias("prediction"))


def _stream(spark: SparkSession, sf_dir: str, make, columns: str) -> DataFrame:  # noqa: ANN001
    """A table as a file stream, through `make`, to a table in memory that the query then reads."""
    name = f"live_{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    run = make(source).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.sql(f"SELECT {columns} FROM {name}")


@query("stream_first_copies", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def stream_first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda s: live.first_copies(s, "user_id", "ts", "3650 days").select("user_id"), "user_id, 1L AS n")


@query("stream_daily_counts")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda s: live.daily_counts(s, "event_type", "value", "ts"), "cast(day as string) AS day, event_type, n, round(mean, 6) AS mean")


@query("latest_per_group", "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("event_type", "user_id", "event_id")
