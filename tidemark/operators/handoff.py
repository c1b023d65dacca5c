"""Packages for a reader downstream: checks of context rows, bundles of evidence, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What fails a package; other issues are warnings.
HARD = ("empty_body_excerpt", "empty_document_hash", "invalid_timestamp", "available_after_decision", "available_after_cutoff", "cutoff_after_decision", "available_before_published", "invalid_rank", "duplicate_context_row")


def issues(rows: DataFrame) -> DataFrame:
    """(doc_id, query_id, method, issue) of context rows; each row is read once, and may have several."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    untimed = F.col("decision_time").isNull() | F.col("retrieval_cutoff").isNull() | F.col("published_at").isNull() | F.col("available_at").isNull()
    again = F.row_number().over(Window.partitionBy("query_id", "method", "doc_id").orderBy("rank"))
    tests = {
        "empty_body_excerpt": empty("body_excerpt"), "empty_document_hash": empty("document_hash"), "invalid_timestamp": untimed,
        "available_after_decision": F.col("available_at") > F.col("decision_time"), "available_after_cutoff": F.col("available_at") > F.col("retrieval_cutoff"),
        "cutoff_after_decision": F.col("retrieval_cutoff") > F.col("decision_time"), "available_before_published": F.col("available_at") < F.col("published_at"),
        "invalid_rank": F.coalesce(F.col("rank") < 1, F.lit(True)), "duplicate_context_row": F.col("again_") > 1,
    }
    found = F.array_compact(F.array(*[F.when(t if k in ("invalid_timestamp", "empty_body_excerpt", "empty_document_hash") else t & ~untimed, k) for k, t in tests.items()]))
    return rows.withColumn("again_", again).select("query_id", "method", "doc_id", F.explode(found).alias("issue"))


def report(rows: DataFrame) -> DataFrame:
    """One row: counts of rows, documents and queries, and whether the package passes."""
    counts = rows.agg(F.count("*").alias("row_count"), F.count_distinct("doc_id").alias("unique_docs"), F.count_distinct("query_id").alias("queries"), F.count_if(F.col("evidence_scope") == "stock").alias("stock_rows"), F.round(F.min("final_score"), 6).alias("score_min"), F.round(F.max("final_score"), 6).alias("score_max"))
    bad = issues(rows).agg(F.count("*").alias("issue_count"))
    return counts.crossJoin(bad).withColumn("status", F.when(F.col("issue_count") == 0, "passed").otherwise("failed"))


def bundles(rows: DataFrame) -> DataFrame:
    """One nested row for each query and method: evidence by scope in rank order, holdings covered, clusters."""
    document = F.struct("rank", "doc_id", "evidence_scope", "final_score")
    ordered = F.array_sort(F.collect_list(document))
    out = rows.groupBy("query_id", "method").agg(
        ordered.alias("portfolio_evidence"), F.count("*").alias("document_count"), F.count_distinct(F.coalesce("cluster", F.col("doc_id").cast("string"))).alias("unique_clusters"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("matched_tickers", F.upper))))).alias("covered_holdings"),
    )
    of = lambda s: F.filter("portfolio_evidence", lambda x: x["evidence_scope"] == s)
    out = out.withColumns({f"{s}_evidence": of(s) for s in ("stock", "sector", "market")})
    return out.withColumn("evidence_bundle_id", F.concat_ws(":", F.col("query_id").cast("string"), "method"))


def bundle_issues(rows: DataFrame) -> DataFrame:
    return rows.filter((F.size("portfolio_evidence") == 0) | (F.col("evidence_bundle_id") == "")).select("evidence_bundle_id", F.lit("empty_portfolio_evidence").alias("issue"))


def missing_outputs(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """Keys that should have been produced and weren't, and the other way round."""
    gone = expected.select(key).distinct().join(produced, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = produced.select(key).distinct().join(expected, key, "left_anti").withColumn("side", F.lit("unexpected"))
    return gone.unionByName(extra)


def prompt(**fields: Column) -> Column:
    """A JSON object of the named fields, in that order."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def prediction(raw: Column) -> Column:
    """What a model said, freed from a code fence and read as JSON; intensities within bounds, signals a known list."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    said = F.from_json(body, "sentiment double, risk double, signals array<string>, direction string")
    clip = lambda x, low: F.greatest(F.lit(low), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    known = F.array(*[F.lit(s) for s in ("rates", "inflation", "credit", "energy", "housing")])
    return F.struct(clip(said["sentiment"], -1.0).alias("sentiment"), clip(said["risk"], 0.0).alias("risk"), F.array_sort(F.array_intersect(F.coalesce(said["signals"], F.array().cast("array<string>")), known)).alias("signals"), F.coalesce(said["direction"], F.lit("neutral")).alias("direction"))
