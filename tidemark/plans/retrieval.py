"""Queries of retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import times as S
from tidemark.operators import retrieval as R
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, DECISIONS, KEYWORDS, corpus, decisions, tokens_sql

BM25 = f"""
tok AS (SELECT doc_id, unnest({tokens_sql("body")}) AS term FROM corpus),
lens AS (SELECT doc_id, len({tokens_sql("body")}) AS dl FROM corpus),
stats AS (SELECT greatest(count(*), 1) AS n, avg(dl) AS avgdl FROM lens),
posts AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_sql("query_text")}) AS term FROM decisions) GROUP BY ALL),
scores AS (
  SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM qt JOIN posts USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL)"""


@query("postings", f"WITH {CORPUS} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('body')}) AS term FROM corpus) GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(corpus(spark, sf_dir))


@query("term_frequencies", f"WITH {CORPUS}, tok AS (SELECT DISTINCT doc_id, unnest({tokens_sql('body')}) AS term FROM corpus), d AS (SELECT term, count(*) AS df FROM tok GROUP BY term) SELECT term, df, round(ln(1 + ((SELECT count(*) FROM corpus) - df + 0.5) / (df + 0.5)), 6) AS idf FROM d")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    stats = docs.agg(F.count("*").alias("n"))
    return R.document_frequency(R.postings(docs)).crossJoin(F.broadcast(stats)).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("index_stats", f"WITH {CORPUS} SELECT count(*) AS n_docs, round(avg(len({tokens_sql('body')})), 6) AS avgdl FROM corpus")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_stats(R.lengths(corpus(spark, sf_dir))).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_topk", f"WITH {CORPUS}, {DECISIONS}, {BM25}, r AS (SELECT query_id, doc_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM scores) SELECT query_id, doc_id, bm25, rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = R.bm25(corpus(spark, sf_dir), decisions(spark, sf_dir)).withColumn("bm25", F.round("bm25", 6))
    return R.top_k(scores, 10, ["query_id"], [F.desc("bm25"), F.asc("doc_id")])


@query("causal_filter", f"WITH {CORPUS}, {DECISIONS} SELECT query_id, count(*) AS n_docs, max(available_at) AS newest FROM decisions JOIN corpus ON available_at <= decision_time GROUP BY query_id")
def causal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.causal_counts(corpus(spark, sf_dir).select("doc_id", "available_at"), decisions(spark, sf_dir))


@query("lookback_join", f"WITH {CORPUS}, {DECISIONS} SELECT query_id, doc_id FROM decisions JOIN corpus ON available_at <= decision_time AND available_at >= decision_time - INTERVAL 7 DAY")
def lookback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.within_lookback(corpus(spark, sf_dir).select("doc_id", "available_at"), decisions(spark, sf_dir).select("query_id", "decision_time"), 7).select("query_id", "doc_id")


_HITS = " + ".join(f"CAST(contains(lower(body), '{k}') AS INT)" for k in KEYWORDS)
CANDIDATES = f"""
cand AS (
  SELECT d.query_id, c.*, holdings, sizes, decision_time, coalesce(bm25, 0) AS bm25,
    list_sort(list_filter(tickers, lambda t: list_contains(holdings, t))) AS matched_tickers,
    coalesce(list_sum(list_transform(list_filter(tickers, lambda t: list_contains(holdings, t)), lambda t: sizes[list_position(holdings, t)])), 0) AS portfolio_weight_sum
  FROM decisions d JOIN corpus c ON available_at <= decision_time LEFT JOIN scores s ON s.query_id = d.query_id AND s.doc_id = c.doc_id),
parts AS (
  SELECT *, CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) WHEN bm25 > 0 THEN 1.0 ELSE 0.0 END AS sparse_score,
    least(1.0, len(matched_tickers) / 3.0) AS entity_score, least(1.0, portfolio_weight_sum / 0.5) AS exposure_score,
    exp(-0.1 * greatest(epoch(decision_time) - epoch(published_at), 0) / 86400.0) AS recency_score,
    least(1.0, ({_HITS}) / 3.0) AS event_score, least(1.0, greatest(0.0, credibility)) AS credibility_score,
    CASE WHEN len(matched_tickers) > 0 THEN 'stock' WHEN len(sectors) > 0 THEN 'sector' ELSE 'market' END AS evidence_scope
  FROM cand WINDOW w AS (PARTITION BY query_id))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = corpus(spark, sf_dir), decisions(spark, sf_dir)
    hashed = docs.withColumn("cluster", X.content_hash(F.lit(""), "body"))
    rows = R.hybrid_candidates(hashed, queries.drop("query_text"), R.bm25(docs, queries), KEYWORDS)
    return rows.withColumn("evidence_scope", R.scope(F.col("matched_tickers"), F.col("sectors")))


_FINAL = "round(0.40 * sparse_score + 0.20 * entity_score + 0.25 * exposure_score + 0.10 * recency_score + 0.05 * event_score, 6)"


@query("hybrid_rank", f"WITH {CORPUS}, {DECISIONS}, {BM25}, {CANDIDATES}, r AS (SELECT *, {_FINAL} AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY {_FINAL} DESC, doc_id) AS rank FROM parts) SELECT query_id, doc_id, rank, final_score, round(sparse_score, 6) AS sparse_score, round(entity_score, 6) AS entity_score, round(exposure_score, 6) AS exposure_score, round(recency_score, 6) AS recency_score, round(event_score, 6) AS event_score, array_to_string(matched_tickers, '|') AS matched, evidence_scope FROM r WHERE rank <= 10")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("final_score", F.round(R.final_score("full_hybrid"), 6))
    best = R.top_k(rows, 10, ["query_id"], [F.desc("final_score"), F.asc("doc_id")])
    return best.select("query_id", "doc_id", "rank", "final_score", *[F.round(c, 6).alias(c) for c in ("sparse_score", "entity_score", "exposure_score", "recency_score", "event_score")], F.array_join("matched_tickers", "|").alias("matched"), "evidence_scope")


_METHOD_ROWS = ", ".join(f"('{m}', {', '.join(map(str, w))})" for m, w in R.METHODS.items())


@query("ablation_methods", f"WITH {CORPUS}, {DECISIONS}, {BM25}, {CANDIDATES}, m AS (SELECT * FROM (VALUES {_METHOD_ROWS}) AS t(method, ws, wd, we, wp, wr, wv, wc)), f AS (SELECT method, query_id, doc_id, round(ws * sparse_score + we * entity_score + wp * exposure_score + wr * recency_score + wv * event_score + wc * credibility_score, 6) AS score FROM parts, m), r AS (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT method, query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def ablation_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All methods and queries in one plan: each candidate row gives one row a method."""
    scored = candidates(spark, sf_dir).select("query_id", "doc_id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.round(R.final_score(m), 6).alias("score")) for m in R.METHODS])).alias("m"))
    return R.top_k(scored.select("m.method", "query_id", "doc_id", "m.score"), 5, ["method", "query_id"], [F.desc("score"), F.asc("doc_id")])


@query("diversified_topk")
def diversified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("final_score", F.round(R.final_score("full_hybrid_diversified"), 6))
    return R.diversified(rows, 10).drop("matched_tickers")


@query("minmax_norm", f"WITH {CORPUS}, {DECISIONS}, {BM25} SELECT query_id, doc_id, round(CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) WHEN bm25 > 0 THEN 1.0 ELSE 0.0 END, 6) AS scaled FROM scores WINDOW w AS (PARTITION BY query_id)")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(corpus(spark, sf_dir), decisions(spark, sf_dir)).select("query_id", "doc_id", F.round(R.min_max(F.col("bm25"), ["query_id"]), 6).alias("scaled"))


@query("reason_tags", f"""WITH {CORPUS}, {DECISIONS}, p AS (
  SELECT query_id, doc_id, credibility, event_tags, sectors, greatest(epoch(decision_time) - epoch(published_at), 0) / 3600.0 AS hours,
    list_filter(tickers, lambda t: list_contains(holdings, t)) AS matched,
    coalesce(list_sum(list_transform(list_filter(tickers, lambda t: list_contains(holdings, t)), lambda t: sizes[list_position(holdings, t)])), 0) AS expo
  FROM decisions JOIN corpus ON available_at <= decision_time AND available_at >= decision_time - INTERVAL 2 DAY)
SELECT query_id, doc_id, concat_ws('|', CASE WHEN len(matched) > 0 THEN 'stock_scope' WHEN len(sectors) > 0 THEN 'sector_scope' ELSE 'market_scope' END,
  CASE WHEN len(matched) > 0 THEN 'exact_ticker' END, CASE WHEN len(matched) > 0 AND expo >= 0.375 THEN 'high_exposure' END, 'event_' || event_tags[1],
  CASE WHEN hours <= 2 THEN 'fresh_2h' WHEN hours <= 24 THEN 'fresh_24h' WHEN hours <= 72 THEN 'fresh_3d' ELSE 'older_context' END,
  CASE WHEN credibility >= 0.8 THEN 'high_source_credibility' END) AS tags FROM p""")
def reason_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.within_lookback(corpus(spark, sf_dir), decisions(spark, sf_dir), 2)
    matched = F.array_intersect("tickers", F.map_keys("weights"))
    total, _ = R.exposure(F.col("tickers"), F.col("weights"))
    hours = S.age_days(F.col("decision_time"), F.col("published_at")) * 24
    tags = F.array(
        F.concat(R.scope(matched, F.col("sectors")), F.lit("_scope")),
        F.when(F.size(matched) > 0, "exact_ticker"),
        F.when((F.size(matched) > 0) & (total >= 0.75 * F.array_max(F.transform(F.map_values("weights"), F.abs))), "high_exposure"),
        X.slug("event", F.get("event_tags", F.lit(0))),
        S.freshness(hours),
        F.when(F.col("credibility") >= 0.8, "high_source_credibility"),
    )
    return rows.select("query_id", "doc_id", F.array_join(F.array_distinct(F.array_compact(tags)), "|").alias("tags"))


@query("age_decay", f"WITH {CORPUS}, a AS (SELECT doc_id, greatest(epoch(TIMESTAMP '2020-03-01') - epoch(available_at), 0) / 86400.0 AS age FROM corpus) SELECT doc_id, round(age, 6) AS age_days, round(exp(-age / 7.0), 6) AS decay_7d, round(exp(-age / 30.0), 6) AS decay_30d, round(exp(-age / 90.0), 6) AS decay_90d, CASE WHEN age <= 1 THEN '0_1d' WHEN age <= 7 THEN '2_7d' WHEN age <= 30 THEN '8_30d' WHEN age <= 90 THEN '31_90d' ELSE 'over_90d' END AS age_bucket FROM a")
def age_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = S.age_days(F.lit("2020-03-01").cast("timestamp_ntz"), F.col("available_at"))
    return corpus(spark, sf_dir).select("doc_id", F.round(age, 6).alias("age_days"), *[F.round(S.decay(age, w), 6).alias(f"decay_{w}d") for w in (7, 30, 90)], S.age_bucket(age).alias("age_bucket"))


_REGIME = "CASE " + " ".join(f"WHEN day < TIMESTAMP '{begin}' THEN '{before}'" for (_, before), (begin, _) in zip(S.REGIMES, S.REGIMES[1:], strict=False)) + f" ELSE '{S.REGIMES[-1][1]}' END"


@query("regime_buckets", f"WITH d AS (SELECT o_orderkey, TIMESTAMP '2010-01-01' + to_days(CAST(o_orderkey % 5000 AS INT)) AS day FROM orders) SELECT {_REGIME} AS regime, CASE WHEN day < TIMESTAMP '2021-10-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM d GROUP BY ALL")
def regime_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("timestamp_ntz'2010-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 5000 as int))").alias("day"))
    return d.groupBy(S.regime_of(F.col("day")).alias("regime"), S.split_of(F.col("day")).alias("split")).agg(F.count("*").alias("n"))


@query("query_builder", f"WITH {DECISIONS} SELECT query_id, holdings[1] || ' ' || holdings[1] || ' ' || holdings[2] || ' ' || holdings[3] AS query_text FROM decisions")
def query_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings by size of weight; terms of the largest (all of them, if several are) stand twice."""
    pairs = F.map_entries("weights")
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct((-F.abs(p["value"])).alias("size"), p["key"].alias("tic"))))
    most = F.array_min(F.transform(ordered, lambda p: p["size"]))
    terms = F.flatten(F.transform(ordered, lambda p: F.array_repeat(p["tic"], F.when(p["size"] <= most, 2).otherwise(1))))
    return decisions(spark, sf_dir).select("query_id", F.array_join(terms, " ").alias("query_text"))
