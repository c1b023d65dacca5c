"""Queries of evaluation, judgments and review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, JUDGMENTS, RUNS, corpus, judgments, runs

BASE = f"{RUNS}, {JUDGMENTS}"
METRICS = f"""{BASE},
j AS (SELECT r.method, r.query_id, r.doc_id, r.rank, coalesce(relevance, 0) AS rel, relevance IS NOT NULL AS judged FROM runs r LEFT JOIN judgments q USING (query_id, doc_id)),
h AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY method, query_id ORDER BY rank) AS hits FROM j),
i AS (SELECT query_id, sum(CASE WHEN place <= 5 THEN (2.0 ** relevance - 1) / log2(place + 1) ELSE 0 END) AS i5, sum(CASE WHEN place <= 10 THEN (2.0 ** relevance - 1) / log2(place + 1) ELSE 0 END) AS i10
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM judgments) GROUP BY query_id),
m AS (SELECT method, query_id, sum(CASE WHEN rank <= 5 AND rel > 0 THEN 1 ELSE 0 END) / 5.0 AS p_small, sum(CASE WHEN rank <= 10 AND rel > 0 THEN 1 ELSE 0 END) / 10.0 AS p,
  sum(CASE WHEN rank <= 5 THEN (2.0 ** rel - 1) / log2(rank + 1) ELSE 0 END) AS d5, sum(CASE WHEN rank <= 10 THEN (2.0 ** rel - 1) / log2(rank + 1) ELSE 0 END) AS d10,
  coalesce(sum(CASE WHEN rel > 0 THEN hits / rank::DOUBLE END) / nullif(sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END), 0), 0) AS ap, coalesce(1.0 / min(CASE WHEN rel > 0 THEN rank END), 0) AS rr
  FROM h GROUP BY ALL),
x AS (SELECT method, query_id, p_small, p, CASE WHEN i5 > 0 THEN d5 / i5 ELSE 0 END AS ndcg_small, CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END AS ndcg, ap, rr FROM m LEFT JOIN i USING (query_id))"""
NAMES = ["p_small", "p", "ndcg_small", "ndcg", "ap", "rr"]


@query("ir_metrics", f"WITH {METRICS} SELECT method, query_id, {', '.join(f'round({c}, 6) AS {c}' for c in NAMES)} FROM x")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(runs(spark, sf_dir), judgments(spark, sf_dir)).select("method", "query_id", *[F.round(c, 6).alias(c) for c in NAMES])


@query("ir_summary", f"WITH {METRICS} SELECT method, count(*) AS queries, {', '.join(f'round(avg({c}), 4) AS {c}' for c in NAMES)} FROM x GROUP BY method")
def ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(E.metrics(runs(spark, sf_dir), judgments(spark, sf_dir)), NAMES)


@query("ndcg_by_query", f"WITH {METRICS} SELECT query_id, round(max(ndcg), 6) AS best_ndcg, arg_max(method, ROW(round(ndcg, 6), method)) AS best_method FROM x GROUP BY query_id")
def ndcg_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.metrics(runs(spark, sf_dir), judgments(spark, sf_dir))
    return rows.groupBy("query_id").agg(F.round(F.max("ndcg"), 6).alias("best_ndcg"), F.max_by("method", F.struct(F.round("ndcg", 6), "method")).alias("best_method"))


COVERAGE = f"""WITH {METRICS}, c AS (SELECT method, query_id, count(*) AS retrieved, CAST(sum(CASE WHEN judged THEN 1 ELSE 0 END) AS BIGINT) AS judged, avg(CASE WHEN judged THEN 1.0 ELSE 0 END) AS judged_rate,
  coalesce(string_agg(doc_id, '|' ORDER BY rank) FILTER (WHERE NOT judged), '') AS unjudged FROM j WHERE rank <= 10 GROUP BY ALL)"""


@query("qrels_coverage", f"{COVERAGE} SELECT method, query_id, retrieved, judged, round(judged_rate, 6) AS judged_rate, unjudged FROM c")
def qrels_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(runs(spark, sf_dir), judgments(spark, sf_dir), 10).withColumn("judged_rate", F.round("judged_rate", 6))


@query("coverage_summary", f"{COVERAGE} SELECT method, count(*) AS queries, round(avg(judged_rate), 4) AS judged_rate, count_if(judged_rate < 0.8) AS below_80, count_if(judged_rate < 1) AS below_100 FROM c GROUP BY method")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.coverage(runs(spark, sf_dir), judgments(spark, sf_dir), 10)
    return rows.groupBy("method").agg(F.count("*").alias("queries"), F.round(F.avg("judged_rate"), 4).alias("judged_rate"), F.count_if(F.col("judged_rate") < 0.8).alias("below_80"), F.count_if(F.col("judged_rate") < 1).alias("below_100"))


@query("annotation_pool", f"""WITH {BASE}, p AS (SELECT query_id, doc_id, min(CASE WHEN rank > 0 THEN rank END) AS best_rank, string_agg(DISTINCT method, '|' ORDER BY method) AS methods, string_agg(method || ':' || rank, '|' ORDER BY method, rank) AS ranks FROM runs GROUP BY ALL)
SELECT p.*, relevance, CASE WHEN relevance IS NOT NULL THEN 'already_labeled' WHEN best_rank <= 5 THEN 'high_missing_label' WHEN best_rank <= 10 THEN 'missing_label' ELSE 'low' END AS priority FROM p LEFT JOIN judgments USING (query_id, doc_id)""")
def annotation_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.annotation_pool(runs(spark, sf_dir), judgments(spark, sf_dir))


@query("label_histogram", f"WITH {JUDGMENTS} SELECT query_id, count(*) AS labels, round(avg(relevance), 6) AS mean_relevance, {', '.join(f'count_if(relevance = {r}) AS label_{r}' for r in range(4))} FROM judgments GROUP BY query_id")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_histogram(judgments(spark, sf_dir))


@query("qrels_issues", f"""WITH {BASE}, q AS (SELECT * FROM judgments UNION ALL SELECT query_id, doc_id, 7 FROM judgments WHERE doc_id % 50 = 0)
SELECT 'bad_label' AS issue, query_id, doc_id FROM q WHERE relevance NOT IN (0, 1, 2, 3) UNION ALL SELECT 'duplicate', query_id, doc_id FROM q GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'unlabeled', query_id, doc_id FROM (SELECT DISTINCT query_id, doc_id FROM runs WHERE rank <= 10) WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM q)""")
def qrels_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = judgments(spark, sf_dir)
    return E.qrels_issues(q.union(q.filter("doc_id % 50 = 0").withColumn("relevance", F.lit(7))), runs(spark, sf_dir), 10)


REVIEW = f"""WITH {METRICS}, c AS (SELECT query_id, doc_id, rank AS candidate_rank FROM runs WHERE method = 'm1'), b AS (SELECT query_id, doc_id, rank AS baseline_rank FROM runs WHERE method = 'm2'),
r AS (SELECT query_id, doc_id, candidate_rank, baseline_rank, coalesce(relevance, 0) AS rel, coalesce(ndcg, 0) AS ndcg FROM c LEFT JOIN b USING (query_id, doc_id) LEFT JOIN judgments USING (query_id, doc_id) LEFT JOIN (SELECT query_id, ndcg FROM x WHERE method = 'm1') USING (query_id)),
s AS (SELECT query_id, doc_id, candidate_rank, baseline_rank, CASE WHEN candidate_rank <= 10 THEN 45 - candidate_rank ELSE 0 END + CASE WHEN baseline_rank <= 10 THEN 18 ELSE 0 END + CASE WHEN rel IN (1, 2) THEN 30 ELSE 0 END
  + CASE WHEN candidate_rank <= 10 AND rel <= 1 THEN 26 ELSE 0 END + CASE WHEN candidate_rank > 10 AND rel >= 2 THEN 20 ELSE 0 END + CASE WHEN abs(candidate_rank - baseline_rank) >= 10 AND least(candidate_rank, baseline_rank) <= 15 THEN 14 ELSE 0 END + CASE WHEN ndcg < 0.7 THEN 18 ELSE 0 END AS priority FROM r)"""


@query("review_queue_topk", f"{REVIEW}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, candidate_rank, doc_id) AS own FROM s) SELECT query_id, doc_id, candidate_rank, baseline_rank, priority FROM o WHERE own <= 8 ORDER BY priority DESC, query_id, candidate_rank, doc_id LIMIT 100")
def review_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_runs, q = runs(spark, sf_dir), judgments(spark, sf_dir)
    first = all_runs.filter("method = 'm1'")
    ndcg = E.metrics(first, q).select("query_id", "ndcg")
    return E.review_queue(first, all_runs.filter("method = 'm2'"), q, ndcg, 8, 100)


@query("round_robin_fill", f"WITH {RUNS} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS turn FROM runs WHERE method = 'm1' AND rank <= 20")
def round_robin_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).filter("method = 'm1' AND rank <= 20").select("query_id", "doc_id", "rank")
    return E.round_robin(rows, "query_id", [F.asc("rank"), F.asc("doc_id")]).drop("rank")


@query("coverage_gap_queue", f"""WITH {BASE}, g AS (SELECT query_id, doc_id, max(CASE method WHEN 'm1' THEN 130 ELSE 115 END - rank) AS priority, min(CASE WHEN method = 'm1' THEN rank END) AS candidate_rank, min(CASE WHEN method = 'm2' THEN rank END) AS baseline_rank FROM runs WHERE rank <= 10 GROUP BY ALL)
SELECT g.* FROM g ANTI JOIN judgments USING (query_id, doc_id)""")
def coverage_gap_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda m: F.min(F.when(F.col("method") == m, F.col("rank")))
    rows = runs(spark, sf_dir).filter("rank <= 10").groupBy("query_id", "doc_id").agg(F.max(F.when(F.col("method") == "m1", 130).otherwise(115) - F.col("rank")).alias("priority"), own("m1").alias("candidate_rank"), own("m2").alias("baseline_rank"))
    return rows.join(judgments(spark, sf_dir), ["query_id", "doc_id"], "left_anti")


@query("bootstrap_grades", f"WITH {CORPUS} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN least(1, v) ELSE v END AS grade FROM (SELECT doc_id, CAST(source < 'src3' AS INT) + CAST(list_contains(tickers, 'T1') AS INT) + CAST(event_tags[1] = 'guidance' AS INT) AS v FROM corpus)")
def bootstrap_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = E.bootstrap_grade(F.col("source") < "src3", F.array_contains("tickers", "T1"), F.get("event_tags", F.lit(0)) == "guidance", F.col("doc_id") % 9 == 0)
    return corpus(spark, sf_dir).select("doc_id", grade.alias("grade"))


@query("query_folds", "SELECT item_id AS query_id, (row_number() OVER (ORDER BY item_id) - 1) % 5 AS fold FROM benchmark")
def query_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.folds(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id")), 5)


@query("signal_set_metrics", f"""WITH {CORPUS}, s AS (SELECT doc_id, list_distinct(['a' || (doc_id % 3), 'a' || (doc_id % 4)]) AS gold, CASE WHEN doc_id % 7 = 0 THEN [] ELSE list_distinct(['a' || (doc_id % 5), 'a' || (doc_id % 2)]) END AS pred FROM corpus),
m AS (SELECT doc_id, CASE WHEN len(pred) > 0 THEN len(list_intersect(gold, pred)) / len(pred)::DOUBLE WHEN len(gold) = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, pred)) / len(gold)::DOUBLE ELSE 1.0 END AS r FROM s)
SELECT doc_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def signal_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).selectExpr("doc_id", "array_distinct(array(concat('a', cast(doc_id % 3 as string)), concat('a', cast(doc_id % 4 as string)))) as gold", "if(doc_id % 7 = 0, cast(array() as array<string>), array_distinct(array(concat('a', cast(doc_id % 5 as string)), concat('a', cast(doc_id % 2 as string))))) as pred")
    p, r, f1 = E.set_metrics(F.col("gold"), F.col("pred"))
    return rows.select("doc_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query("query_diagnostics", f"""WITH {CORPUS}, {RUNS}, r AS (SELECT method, query_id, rank, available_at, TIMESTAMP '2020-01-20' AS decision_time, sha256(body) AS cluster, credibility, CASE WHEN list_contains(tickers, 'T' || query_id) THEN 'stock' WHEN len(sectors) > 0 THEN 'sector' ELSE 'market' END AS evidence_scope FROM runs JOIN corpus USING (doc_id))
SELECT method, query_id, count(*) AS rows, round(avg(CASE WHEN available_at <= decision_time THEN 1.0 ELSE 0 END), 6) AS causal_rate, round(1 - count(DISTINCT cluster) / count(*)::DOUBLE, 6) AS duplicate_rate,
  {', '.join(f"round(avg(CASE WHEN evidence_scope = '{s}' THEN 1.0 ELSE 0 END), 6) AS {s}_share" for s in ('stock', 'sector', 'market'))}, round(avg(credibility), 6) AS mean_credibility FROM r WHERE rank <= 10 GROUP BY ALL""")
def query_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).join(corpus(spark, sf_dir), "doc_id").withColumns({"decision_time": F.lit("2020-01-20").cast("timestamp_ntz"), "cluster": F.sha2("body", 256)})
    scope = F.when(F.array_contains("tickers", F.concat(F.lit("T"), F.col("query_id").cast("string"))), "stock").when(F.size("sectors") > 0, "sector").otherwise("market")
    return E.query_diagnostics(rows.withColumn("evidence_scope", scope), 10)
