"""Queries of reviewers' queues and pools, windows and caps, fits, contexts and labels of charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import evaluation as E
from tidemark.operators import queues as Q
from tidemark.operators import retrieval as R
from tidemark.operators import rules
from tidemark.plans.labels import _first
from tidemark.plans.registry import query
from tidemark.plans.retrieval import _REGIME, BM25, CANDIDATES, candidates
from tidemark.plans.roles import CORPUS, DECISIONS, JUDGMENTS, PANEL, RUNS, corpus, judgments, panel, runs, table
from tidemark.plans.search import POOL, pool

QUEUE = f"""{RUNS}, {JUDGMENTS}, c AS (SELECT query_id, doc_id, rank AS rank_candidate FROM runs WHERE method = 'm1' AND rank <= 30), b AS (SELECT query_id, doc_id, rank AS rank_baseline FROM runs WHERE method = 'm2' AND rank <= 30),
d AS (SELECT c.query_id, sum(CASE WHEN rank_candidate <= 10 THEN (2.0 ** coalesce(relevance, 0) - 1) / log2(rank_candidate + 1) ELSE 0 END) AS dcg FROM c LEFT JOIN judgments USING (query_id, doc_id) GROUP BY ALL), i AS (SELECT query_id, sum((2.0 ** relevance - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM judgments) WHERE place <= 10 GROUP BY ALL),
n AS (SELECT query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 9) AS ndcg FROM d LEFT JOIN i USING (query_id)), r AS (SELECT c.*, rank_baseline, coalesce(relevance, 0) AS l, ndcg, coalesce(rank_baseline, 9999) AS rb FROM c LEFT JOIN b USING (query_id, doc_id) LEFT JOIN judgments USING (query_id, doc_id) LEFT JOIN n USING (query_id)),
p AS (SELECT *, CASE WHEN rank_candidate <= 10 THEN 45 - rank_candidate ELSE 0 END + CASE WHEN rb <= 10 THEN 18 ELSE 0 END + CASE WHEN l IN (1, 2) THEN 30 ELSE 0 END + CASE WHEN rank_candidate <= 10 AND l <= 1 THEN 26 ELSE 0 END + CASE WHEN rank_candidate > 10 AND l >= 2 THEN 20 ELSE 0 END + CASE WHEN abs(rb - rank_candidate) >= 10 AND least(rb, rank_candidate) <= 15 THEN 14 ELSE 0 END + CASE WHEN coalesce(ndcg, 1) < 0.7 THEN 18 ELSE 0 END AS priority FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_candidate, priority DESC, doc_id) AS p1, row_number() OVER (PARTITION BY query_id ORDER BY rank_baseline NULLS LAST, priority DESC, doc_id) AS p2, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, rank_candidate, doc_id) AS p3 FROM p),
t AS (SELECT *, CASE WHEN p1 <= 3 THEN p1 WHEN rank_baseline IS NOT NULL AND p2 <= 2 THEN 3 + p2 WHEN p3 <= 4 THEN 5 + p3 END AS turn FROM w), o AS (SELECT *, row_number() OVER (ORDER BY turn IS NULL, CASE WHEN turn IS NOT NULL THEN query_id END, turn, priority DESC, query_id, rank_candidate, doc_id) AS place FROM t)"""


@query("review_pool_queue", f"WITH {QUEUE} SELECT 'review_' || lpad(CAST(place AS VARCHAR), 4, '0') AS review_id, query_id, doc_id, rank_candidate, rank_baseline, CAST(priority AS INT) AS priority FROM o WHERE place <= 190")
def review_pool_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, qrels = runs(spark, sf_dir).filter("rank <= 30"), judgments(spark, sf_dir)
    candidate, baseline = (every.filter(F.col("method") == m) for m in ("m1", "m2"))
    ndcg = E.metrics(candidate, qrels).select("query_id", F.round("ndcg", 9).alias("ndcg"))
    out = Q.pooled_queue(candidate, baseline, qrels, ndcg, 190, 4)
    return out.select("review_id", "query_id", "doc_id", "rank_candidate", "rank_baseline", F.col("priority").cast("int").alias("priority"))


RESULTS = "res AS (SELECT doc_id % 7 AS query_id, doc_id // 7 AS surface_rank, doc_id * 3 % 101 AS doc_id, 'g' || doc_id % 5 AS group_key, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [doc_id * 5 % 103, doc_id * 7 % 107] END AS children FROM documents)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id % 7 as query_id", "doc_id div 7 as surface_rank", "doc_id * 3 % 101 as doc_id", "concat('g', cast(doc_id % 5 as string)) as group_key", "if(doc_id % 3 = 0, cast(array() as array<bigint>), array(doc_id * 5 % 103, doc_id * 7 % 107)) as children")


POOLED = f"{RESULTS}, pooled AS (SELECT query_id, surface_rank, 0 AS child_rank, doc_id, group_key, 'document' AS surface_kind FROM res UNION ALL SELECT query_id, surface_rank, u.i, children[u.i], group_key, 'group_child' FROM res, unnest([1, 2]) AS u(i) WHERE len(children) >= u.i)"


@query("pool_rows", f"WITH {POOLED} SELECT query_id, surface_rank, CAST(child_rank AS INT) AS child_rank, doc_id, group_key, surface_kind FROM pooled")
def pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.pool_of(_results(spark, sf_dir)).select("query_id", "surface_rank", "child_rank", "doc_id", "group_key", "surface_kind")


@query("merged_pool", f"WITH {POOLED}, m AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY surface_rank, child_rank) AS n FROM pooled) SELECT query_id, doc_id, surface_rank, CAST(child_rank AS INT) AS child_rank, surface_kind, group_key FROM m WHERE n = 1")
def merged_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.merged_pool(Q.pool_of(_results(spark, sf_dir)))


@query("portfolio_level", f"WITH {POOL}, f AS (SELECT *, doc_id % 31 AS q, (starts_with(lower(coalesce(source_type, '')), 'official_macro') OR list_contains(tickers, 'MARKET')) AND doc_id % 31 <> 5 AS wide FROM pool), g AS (SELECT *, bool_or(wide) OVER (PARTITION BY q) AS any_wide FROM f) SELECT q, doc_id FROM g WHERE wide OR NOT any_wide")
def portfolio_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("doc_id") % 31
    rows = pool(spark, sf_dir).select(q.alias("q"), "doc_id", F.when(q != 5, F.col("source_type")).alias("source_type"), F.when(q != 5, F.col("tickers")).otherwise(F.array().cast("array<string>")).alias("tickers"))
    return Q.portfolio_level(rows, ["q"]).select("q", "doc_id")


@query("chart_window", f"WITH {PANEL} SELECT tic, day_no, CAST(date AS VARCHAR) AS date, value FROM (SELECT *, max(date) OVER (PARTITION BY tic) AS latest FROM panel) WHERE date >= latest - 90")
def chart_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.last_days(panel(spark, sf_dir), "tic", "date", 90).select("tic", "day_no", F.col("date").cast("string").alias("date"), "value")


@query("capped_candidates", "WITH c AS (SELECT user_id % 29 AS source, 'https://x.example/' || event_id % 211 AS url, max(round(value, 4)) AS score FROM events GROUP BY ALL) SELECT source, url, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, url) AS place FROM c QUALIFY place <= 7")
def capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 29).alias("source"), F.concat(F.lit("https://x.example/"), (F.col("event_id") % 211).cast("string")).alias("url"), F.round("value", 4).alias("score"))
    return Q.capped(e, "source", "url", "score", 7)


FITTED = """fit AS (SELECT o_custkey % 6 AS model, 'c' || o_orderkey % 4 AS real, 'c' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 ELSE o_orderkey % 4 END AS predicted FROM orders),
k AS (SELECT model, real AS k, count(*) AS rn, 0 AS pn, sum((real = predicted)::INT) AS hit FROM fit GROUP BY ALL UNION ALL SELECT model, predicted, 0, count(*), 0 FROM fit GROUP BY ALL), m AS (SELECT model, k, sum(rn) AS rn, sum(pn) AS pn, sum(hit) AS hit FROM k GROUP BY ALL)"""


@query("fit_metrics", f"WITH {FITTED} SELECT model, CAST(sum(rn) AS BIGINT) AS rows, round(sum(hit) / sum(rn), 6) AS accuracy, round(avg(CASE WHEN rn > 0 THEN hit / rn END), 6) AS balanced_accuracy, round(avg(CASE WHEN rn + pn > 0 THEN 2 * hit / (rn + pn) ELSE 0 END), 6) AS macro_f1 FROM m GROUP BY model")
def fit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 6).alias("model"), name(k % 4).alias("real"), name(F.when(k % 3 == 0, k % 5).otherwise(k % 4)).alias("predicted"))
    return Q.fit_metrics(rows, ["model"])


@query("baseline_predictions", f"""WITH {PANEL}, v AS (SELECT tic, day_no, CASE WHEN ret > 0.005 THEN 'up' WHEN ret < -0.005 THEN 'down' ELSE 'flat' END AS y FROM panel), l AS (SELECT *, lag(y) OVER (PARTITION BY tic ORDER BY day_no) AS b FROM v), c AS (SELECT y FROM v WHERE day_no <= 20 GROUP BY y ORDER BY count(*) DESC, y DESC LIMIT 1)
SELECT tic, day_no, y AS real, u.baseline, CASE u.baseline WHEN 'majority' THEN (SELECT y FROM c) ELSE coalesce(b, (SELECT y FROM c)) END AS predicted FROM l, unnest(['majority', 'persistence']) AS u(baseline) WHERE day_no > 20""")
def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = panel(spark, sf_dir).select("tic", "day_no", F.when(F.col("ret") > 0.005, "up").when(F.col("ret") < -0.005, "down").otherwise("flat").alias("y"))
    return Q.baselines(v, "tic", "day_no", "y", F.col("day_no") <= 20)


def _fwd(h: int) -> str:
    return f"CASE WHEN count(ret) OVER w{h} = {h} THEN round(exp(sum(ln(1 + ret)) OVER w{h}) - 1, 8) + 0.0 END AS fwd_return_{h}, CASE WHEN count(ret) OVER w{h} = {h} THEN round(stddev_pop(ret) OVER w{h} * sqrt(252), 7) END AS fwd_volatility_{h}"


@query("forward_targets", f"WITH {PANEL} SELECT tic, day_no, {', '.join(map(_fwd, (1, 5, 21)))} FROM panel WINDOW {', '.join(f'w{h} AS (PARTITION BY tic ORDER BY day_no ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)' for h in (1, 5, 21))}")
def forward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.forward_targets(panel(spark, sf_dir).select("tic", "day_no", "ret"), (1, 5, 21))
    return out.select("tic", "day_no", *[c for h in (1, 5, 21) for c in (F.round(f"fwd_return_{h}", 8).alias(f"fwd_return_{h}"), F.round(f"fwd_volatility_{h}", 7).alias(f"fwd_volatility_{h}"))])


_AGE = "greatest(epoch(decision_time) - epoch(available_at), 0) / 86400.0"
_BUCKET = "CASE WHEN {0} <= 1 THEN '0_1d' WHEN {0} <= 7 THEN '2_7d' WHEN {0} <= 30 THEN '8_30d' WHEN {0} <= 90 THEN '31_90d' ELSE 'over_90d' END"
_FINAL = "round(0.40 * sparse_score + 0.20 * entity_score + 0.25 * exposure_score + 0.10 * recency_score + 0.05 * event_score, 6)"


@query("daily_contexts", f"""WITH {CORPUS}, {DECISIONS}, {BM25}, {CANDIDATES}, r AS (SELECT *, {_FINAL} AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY {_FINAL} DESC, doc_id) AS rank FROM parts), c AS (SELECT *, holdings[1] AS target, {_AGE} AS age, decision_time AS day, event_tags[1] || ' news' AS t FROM r WHERE rank <= 5)
SELECT CAST(CAST(decision_time AS DATE) AS VARCHAR) || ':ticker:' || target || ':' || rank || ':' || doc_id AS daily_context_id, query_id, target AS tic, {_first("t", rules.INTENTS, "'company_risk'")} AS query_intent_primary, round(age, 6) AS age_days, {_BUCKET.format('age')} AS age_bucket, round(exp(-age / 7), 6) AS decay_weight_7d, round(exp(-age / 90), 6) AS decay_weight_90d,
  round(sparse_score, 6) AS bm25_score, CASE WHEN list_contains(tickers, target) THEN 1.0 ELSE 0.0 END::DOUBLE AS ticker_specificity_score, CASE event_tags[1] WHEN 'risk_factors' THEN 0.9 WHEN 'guidance' THEN 0.8 ELSE 0.4 END::DOUBLE AS event_severity_score, CASE WHEN day < TIMESTAMP '2021-10-01' THEN 'train' ELSE 'test' END AS document_split, {_REGIME} AS regime FROM c""")
def daily_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("final_score", F.round(R.final_score("full_hybrid"), 6))
    best = R.top_k(rows, 5, ["query_id"], [F.desc("final_score"), F.asc("doc_id")])
    first = F.element_at(F.map_keys("weights"), 1)
    out = Q.daily_context(best.withColumns({"target": first, "kind": F.lit("news")}), "ticker")
    return out.select("daily_context_id", "query_id", "tic", "query_intent_primary", "age_days", "age_bucket", "decay_weight_7d", "decay_weight_90d", *[f"component_scores.{c}" for c in ("bm25_score", "ticker_specificity_score", "event_severity_score")], "document_split", "regime")


@query("retrieval_records", f"""WITH {CORPUS}, {DECISIONS}, {BM25}, {CANDIDATES}, r AS (SELECT *, {_FINAL} AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY {_FINAL} DESC, doc_id) AS rank FROM parts), e AS (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS flat FROM r WHERE rank <= 10)
SELECT query_id || ':full_hybrid' AS evidence_bundle_id, strftime(decision_time, '%Y-%m-%dT%H:%M:%SZ') AS retrieval_cutoff, rank, doc_id, source, strftime(available_at, '%Y-%m-%dT%H:%M:%SZ') AS available_at, CASE WHEN length(flat) <= 200 THEN flat ELSE rtrim(substr(flat, 1, 197)) || '...' END AS body_excerpt, array_to_string(matched_tickers, '|') AS matched_tickers,
  round(credibility, 6) AS source_credibility, evidence_scope, round(portfolio_weight_sum, 6)::DOUBLE AS portfolio_weight_sum, round(sparse_score, 6) AS sparse_score, 0.0::DOUBLE AS dense_score, round(exposure_score, 6)::DOUBLE AS portfolio_exposure_score, final_score, 'linear_score' AS ranking_stage FROM e""")
def retrieval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir).withColumn("final_score", F.round(R.final_score("full_hybrid"), 6))
    best = R.top_k(rows, 10, ["query_id"], [F.desc("final_score"), F.asc("doc_id")])
    best = best.join(corpus(spark, sf_dir).select("doc_id", X.excerpt("body", 200).alias("body_excerpt")), "doc_id")
    six = lambda c, name: F.round(F.col(c).cast("double"), 6).alias(name)
    return best.select(
        F.concat(F.col("query_id").cast("string"), F.lit(":full_hybrid")).alias("evidence_bundle_id"), F.date_format("decision_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieval_cutoff"), "rank", "doc_id", "source",
        F.date_format("available_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("available_at"), "body_excerpt", F.array_join("matched_tickers", "|").alias("matched_tickers"), six("credibility", "source_credibility"), "evidence_scope",
        six("portfolio_weight_sum", "portfolio_weight_sum"), six("sparse_score", "sparse_score"), F.lit(0.0).alias("dense_score"), six("exposure_score", "portfolio_exposure_score"), "final_score", F.lit("linear_score").alias("ranking_stage"),
    )


@query("ranked_lists", f"WITH {RUNS} SELECT method, query_id, string_agg(doc_id, '|' ORDER BY rank) AS docs FROM runs GROUP BY ALL")
def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.ranked_lists(runs(spark, sf_dir)).withColumn("docs", F.array_join(F.transform("docs", lambda d: d.cast("string")), "|"))


@query("target_ranks", f"WITH {RUNS}, t AS (SELECT DISTINCT doc_id % 25 AS query_id, doc_id % 60 AS target FROM documents) SELECT t.query_id, target, rank FROM t LEFT JOIN runs r ON r.method = 'm1' AND r.query_id = t.query_id AND r.doc_id = target")
def target_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "documents").select((F.col("doc_id") % 25).alias("query_id"), (F.col("doc_id") % 60).alias("target")).distinct()
    return Q.rank_of(runs(spark, sf_dir).filter("method = 'm1'"), targets)


@query("compact_json", f"""WITH {POOL} SELECT doc_id, '{{"a":"' || lang2 || '","b":"' || rank || '","z":"' || coalesce(source_type, 'none') || '"}}' AS compact, '["' || array_to_string(list_filter(list_transform(string_split_regex(event_tags || ' ; x|', '[|;]'), lambda t: trim(t)), lambda t: t <> ''), '","') || '"]' AS listed FROM (SELECT *, risk_terms AS lang2 FROM pool)""")
def compact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    pairs = F.create_map(F.lit("z"), F.coalesce("source_type", F.lit("none")), F.lit("b"), F.col("rank").cast("string"), F.lit("a"), F.col("risk_terms"))
    return p.select("doc_id", Q.sorted_json(pairs).alias("compact"), F.to_json(X.list_of(F.concat("event_tags", F.lit(" ; x|")))).alias("listed"))


@query("chart_labels", """WITH v AS (SELECT event_id, round(value, 3) + 0.0004 AS a, round(CASE WHEN event_id % 9 = 0 THEN 0 ELSE sin(event_id) * value END, 3) AS b FROM events)
SELECT event_id, printf('%.1f%%', a * 100) AS ratio, CASE WHEN b > 0 THEN 'on' ELSE 'off' END AS flag, printf('%.0f docs', a) AS docs, printf('$%.2f', a) AS per_share, CASE WHEN abs(b) > 1e-9 THEN printf('%+.1f%%', (a - b) / abs(b) * 100) ELSE printf('%+.2f', a - b) END AS change, printf('%+.2f', a - b) AS counted FROM v""")
def chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The SQL's round takes the product to a whole number; F.round(x, 3) would take the decimal that the double is written as.
    thousandths = lambda x: F.when(F.abs(x * 1000) < float("inf"), F.round(x * 1000) / 1000).otherwise(x)
    v = table(spark, sf_dir, "events").select("event_id", (thousandths(F.col("value")) + 0.0004).alias("a"), thousandths(F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(F.sin("event_id") * F.col("value"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select("event_id", Q.value_label(a, "ratio").alias("ratio"), Q.value_label(b, "flag").alias("flag"), Q.value_label(a, "docs").alias("docs"), Q.value_label(a, "USD/share").alias("per_share"), Q.change_label(b, a, "score").alias("change"), Q.change_label(b, a, "terms").alias("counted"))


@query("evidence_rates", f"WITH {POOL} SELECT lang AS lang, count(*) AS rows, round(avg((len(tickers) > 0)::INT), 6) AS linked_rate, round(avg(coalesce((title <> '')::INT, 0)), 6) AS titled_rate FROM (SELECT *, risk_terms AS lang FROM pool) GROUP BY lang")
def evidence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir).select(F.col("risk_terms").alias("lang"), (F.size("tickers") > 0).cast("int").alias("linked"), (F.col("title") != "").cast("int").alias("titled"))
    return Q.covered(p, ["linked", "titled"], ["lang"])
