"""Ranking quality from judged labels, coverage of judgments, pooling and queues for reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["method", "query_id"]


def last_judgment(qrels: DataFrame, order: str) -> DataFrame:
    """One row for each (query, document): the last in file order holds."""
    return qrels.groupBy("query_id", "doc_id").agg(F.max_by("relevance", order).alias("relevance"))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """A run with relevance, 0 where a document wasn't judged, and whether it was."""
    rows = run.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left")
    return rows.select("method", "query_id", "doc_id", "rank", F.coalesce("relevance", F.lit(0)).alias("relevance"), F.col("relevance").isNotNull().alias("judged"))


def gain(relevance: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(place + 1)


def precision_at(k: int) -> Column:
    """Divided by k, however few were retrieved."""
    return F.sum(F.when((F.col("rank") <= k) & (F.col("relevance") > 0), 1).otherwise(0)) / k


def ideal_gains(qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, ideal): the gain of all judgments of a query in their best order, retrieved or not."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    return qrels.withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("place"))).alias("ideal"))


def metrics(run: DataFrame, qrels: DataFrame, k_small: int = 5, k: int = 10) -> DataFrame:
    """Precision, NDCG, average precision over the hits retrieved, and reciprocal rank, for each method and query."""
    rows = judged(run, qrels)
    hit = (F.col("relevance") > 0).cast("int")
    rows = rows.withColumn("hits", F.sum(hit).over(Window.partitionBy(*KEY).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda n: F.sum(F.when(F.col("rank") <= n, gain(F.col("relevance"), F.col("rank"))).otherwise(0.0))
    out = rows.groupBy(*KEY).agg(
        precision_at(k_small).alias("p_small"), precision_at(k).alias("p"), at(k_small).alias("dcg_small"), at(k).alias("dcg"),
        F.coalesce(F.sum(F.when(hit == 1, F.col("hits") / F.col("rank"))) / F.sum(hit), F.lit(0.0)).alias("ap"),
        F.coalesce(1 / F.min(F.when(hit == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
    )
    for n, name in ((k_small, "ideal_small"), (k, "ideal")):
        out = out.join(ideal_gains(qrels, n).withColumnRenamed("ideal", name), "query_id", "left")
    ndcg = lambda d, i: F.when(F.col(i) > 0, F.col(d) / F.col(i)).otherwise(0.0)
    return out.select(*KEY, "p_small", "p", ndcg("dcg_small", "ideal_small").alias("ndcg_small"), ndcg("dcg", "ideal").alias("ndcg"), "ap", "rr")


def summary(rows: DataFrame, columns: list[str], by: str = "method", digits: int = 4) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), digits).alias(c) for c in columns])


def coverage(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Judged share of the first k, of as many as were retrieved, and the unjudged documents in rank order."""
    rows = judged(run, qrels).filter(F.col("rank") <= k)
    missing = F.array_sort(F.collect_list(F.when(~F.col("judged"), F.struct("rank", "doc_id"))))
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("retrieved"), F.sum(F.col("judged").cast("int")).alias("judged"), F.avg(F.col("judged").cast("int")).alias("judged_rate"),
        F.array_join(F.transform(missing, lambda x: x["doc_id"].cast("string")), "|").alias("unjudged"),
    )


def annotation_pool(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row for each (query, document) that any method found: best rank, methods, ranks by method, priority of a label."""
    rows = run.groupBy("query_id", "doc_id").agg(
        F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("best_rank"), F.array_join(F.array_sort(F.collect_set("method")), "|").alias("methods"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "rank"))), lambda x: F.concat(x["method"], F.lit(":"), x["rank"].cast("string"))), "|").alias("ranks"),
    )
    rows = rows.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left")
    priority = F.when(F.col("relevance").isNotNull(), "already_labeled").when(F.col("best_rank") <= 5, "high_missing_label").when(F.col("best_rank") <= 10, "missing_label").otherwise("low")
    return rows.withColumn("priority", priority)


def label_histogram(qrels: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("relevance") == r).alias(f"label_{r}") for r in range(4)]
    return qrels.groupBy("query_id").agg(F.count("*").alias("labels"), F.round(F.avg("relevance"), 6).alias("mean_relevance"), *counts)


def qrels_issues(qrels: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """(issue, query_id, doc_id): labels out of range, judged twice, and documents of a run's first k without a label."""
    bad = qrels.filter(~F.col("relevance").isin(0, 1, 2, 3)).select(F.lit("bad_label").alias("issue"), "query_id", "doc_id")
    twice = qrels.groupBy("query_id", "doc_id").count().filter("count > 1").select(F.lit("duplicate").alias("issue"), "query_id", "doc_id")
    found = run.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    missing = found.join(qrels, ["query_id", "doc_id"], "left_anti").select(F.lit("unlabeled").alias("issue"), "query_id", "doc_id")
    return bad.unionByName(twice).unionByName(missing)


def review_priority(candidate: Column, baseline: Column, relevance: Column, ndcg: Column) -> Column:
    """Points for looking at a document again; a rank of null is one that wasn't retrieved."""
    point = lambda test, n: F.when(test, n).otherwise(0)
    low = F.least(candidate, baseline)
    return (
        F.when(candidate <= 10, 45 - candidate).otherwise(0) + point(baseline <= 10, 18) + point(relevance.isin(1, 2), 30)
        + point((candidate <= 10) & (relevance <= 1), 26) + point((candidate > 10) & (relevance >= 2), 20)
        + point((F.abs(candidate - baseline) >= 10) & (low <= 15), 14) + point(ndcg < 0.7, 18)
    )


def review_queue(candidate: DataFrame, baseline: DataFrame, qrels: DataFrame, ndcg: DataFrame, per_query: int, limit: int) -> DataFrame:
    """At most `per_query` rows of each query and `limit` in all, by points; the limit is the queue's size."""
    c = candidate.select("query_id", "doc_id", F.col("rank").alias("candidate_rank"))
    b = baseline.select("query_id", "doc_id", F.col("rank").alias("baseline_rank"))
    rows = c.join(b, ["query_id", "doc_id"], "left").join(qrels, ["query_id", "doc_id"], "left").join(ndcg, "query_id", "left")
    rows = rows.withColumn("priority", review_priority(F.col("candidate_rank"), F.col("baseline_rank"), F.coalesce("relevance", F.lit(0)), F.coalesce("ndcg", F.lit(0.0))))
    order = [F.desc("priority"), F.asc("query_id"), F.asc("candidate_rank"), F.asc("doc_id")]
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("priority"), "candidate_rank", "doc_id"))).filter(F.col("own") <= per_query)
    return rows.orderBy(*order).limit(limit).select("query_id", "doc_id", "candidate_rank", "baseline_rank", "priority")


def round_robin(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """turn: the first row of each group in turn, then the second, and so on."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def bootstrap_grade(source: Column, entity: Column, intent: Column, wrong: Column) -> Column:
    """0 to 3 by how many of three tests hold; 1 at most for a wrong company or source."""
    votes = source.cast("int") + entity.cast("int") + intent.cast("int")
    return F.when(wrong, F.least(votes, F.lit(1))).otherwise(votes)


def query_diagnostics(rows: DataFrame, k: int) -> DataFrame:
    """Of the first k of each method and query: share available in time, duplicates, scopes, credibility."""
    return rows.filter(F.col("rank") <= k).groupBy(*KEY).agg(
        F.count("*").alias("rows"), F.round(F.avg((F.col("available_at") <= F.col("decision_time")).cast("int")), 6).alias("causal_rate"),
        F.round(1 - F.count_distinct("cluster") / F.count("*"), 6).alias("duplicate_rate"),
        *[F.round(F.avg((F.col("evidence_scope") == s).cast("int")), 6).alias(f"{s}_share") for s in ("stock", "sector", "market")],
        F.round(F.avg("credibility"), 6).alias("mean_credibility"),
    )


def folds(ids: DataFrame, k: int, column: str = "query_id") -> DataFrame:
    """Ids in order, dealt to k folds in turn; there is a row for each query, so one window sorts them."""
    return ids.select(column).distinct().withColumn("fold", (F.row_number().over(Window.orderBy(column)) - 1) % k)


def set_metrics(gold: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets of signals."""
    both = F.size(F.array_intersect(gold, predicted))
    precision = F.when(F.size(predicted) > 0, both / F.size(predicted)).otherwise((F.size(gold) == 0).cast("double"))
    recall = F.when(F.size(gold) > 0, both / F.size(gold)).otherwise(1.0)
    return precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
