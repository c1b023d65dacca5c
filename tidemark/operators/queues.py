"""Queues and pools for reviewers, windows and caps on lists, and how well predictions fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import times
from tidemark.operators import panel as P
from tidemark.operators import rules
from tidemark.operators.evaluation import review_priority


def pooled_queue(candidate: DataFrame, baseline: DataFrame, qrels: DataFrame, ndcg: DataFrame, limit: int, least: int, top_candidate: int = 3, top_baseline: int = 2) -> DataFrame:
    """A queue that first takes, query by query, the best of both runs and the `least` most urgent rows, then the most urgent of all.

    Its order is that of taking: a row that several of a query's lists name stands where the first of them does. The limit is its size.
    """
    rows = candidate.select("query_id", "doc_id", F.col("rank").alias("rank_candidate")).join(baseline.select("query_id", "doc_id", F.col("rank").alias("rank_baseline")), ["query_id", "doc_id"], "left")
    rows = rows.join(qrels.select("query_id", "doc_id", F.col("relevance").alias("label")), ["query_id", "doc_id"], "left").join(ndcg, "query_id", "left")
    rows = rows.withColumns({"label": F.coalesce("label", F.lit(0)), "ndcg": F.coalesce("ndcg", F.lit(1.0))})
    rows = rows.withColumn("priority", review_priority(F.col("rank_candidate"), F.coalesce("rank_baseline", F.lit(9999)), F.col("label"), F.col("ndcg")))
    own, urgent = Window.partitionBy("query_id"), [F.desc("priority"), F.asc("query_id"), F.asc("rank_candidate"), F.asc("doc_id")]
    rows = rows.withColumns({
        "by_candidate": F.row_number().over(own.orderBy("rank_candidate", F.desc("priority"), "doc_id")), "by_baseline": F.row_number().over(own.orderBy(F.asc_nulls_last("rank_baseline"), F.desc("priority"), "doc_id")),
        "by_urgency": F.row_number().over(own.orderBy(*urgent)),
    })
    turn = F.when(F.col("by_candidate") <= top_candidate, F.col("by_candidate")).when(F.col("rank_baseline").isNotNull() & (F.col("by_baseline") <= top_baseline), top_candidate + F.col("by_baseline")).when(F.col("by_urgency") <= least, top_candidate + top_baseline + F.col("by_urgency"))
    rows = rows.withColumn("turn", turn)
    order = [F.asc(F.col("turn").isNull()), F.asc(F.when(F.col("turn").isNotNull(), F.col("query_id"))), F.asc("turn"), *urgent]
    kept = rows.orderBy(*order).limit(limit)
    return kept.withColumn("review_id", F.format_string("review_%04d", F.row_number().over(Window.orderBy(*order))))


def pool_of(results: DataFrame) -> DataFrame:
    """Rows of results (query_id, surface_rank, doc_id, group_key, children) and of their children, with their places."""
    items = F.concat(F.array(F.col("doc_id")), F.coalesce("children", F.array().cast("array<long>")))
    rows = results.select("query_id", "surface_rank", "group_key", F.posexplode(items).alias("child_rank", "doc_id"))
    return rows.withColumn("surface_kind", F.when(F.col("child_rank") > 0, "group_child").otherwise("document")).filter("doc_id IS NOT NULL")


def merged_pool(pool: DataFrame) -> DataFrame:
    """One row for each (query, document): where it stands first on the surface."""
    place = F.struct("surface_rank", "child_rank")
    return pool.groupBy("query_id", "doc_id").agg(F.min(place).alias("place"), F.min_by("surface_kind", place).alias("surface_kind"), F.min_by("group_key", place).alias("group_key")).select("query_id", "doc_id", "place.surface_rank", "place.child_rank", "surface_kind", "group_key")


def portfolio_level(rows: DataFrame, by: list[str]) -> DataFrame:
    """Macro releases and documents of the whole market of each group; all of a group that has none."""
    flag = F.lower(F.coalesce("source_type", F.lit(""))).startswith("official_macro") | F.array_contains("tickers", "MARKET")
    rows = rows.withColumn("wide_", flag).withColumn("any_", F.max("wide_").over(Window.partitionBy(*by)))
    return rows.filter("wide_ OR NOT any_").drop("wide_", "any_")


def last_days(rows: DataFrame, key: str, day: str, days: int | None) -> DataFrame:
    """The rows of each key from its latest day less `days` on; all without a number."""
    if days is None:
        return rows
    latest = F.max(day).over(Window.partitionBy(key))
    return rows.withColumn("from_", F.date_sub(latest, days)).filter(F.col(day) >= F.col("from_")).drop("from_")


def capped(rows: DataFrame, source: str, url: str, score: str, most: int) -> DataFrame:
    """The best `most` candidates of each source, one a URL: the source's list has that size."""
    once = rows.groupBy(source, url).agg(F.max(score).alias(score))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(source).orderBy(F.desc(score), url))).filter(F.col("place") <= most)


def fit_metrics(rows: DataFrame, by: list[str], real: str = "real", predicted: str = "predicted") -> DataFrame:
    """Accuracy, mean recall of the classes that occur and mean F1 of all classes, real or predicted; a share of nothing is 0."""
    pairs = rows.groupBy(*by, real, predicted).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col(real).alias("k"), F.col("n").alias("real_n"), F.lit(0).cast("long").alias("pred_n")), F.struct(F.col(predicted).alias("k"), F.lit(0).cast("long").alias("real_n"), F.col("n").alias("pred_n"))))
    per = pairs.select(*by, F.when(F.col(real) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"), sides.alias("s")).select(*by, "s.k", "s.real_n", "s.pred_n", F.when(F.col("s.real_n") > 0, F.col("hit")).otherwise(0).alias("hit"))
    per = per.groupBy(*by, "k").agg(F.sum("real_n").alias("real_n"), F.sum("pred_n").alias("pred_n"), F.sum("hit").alias("hit"))
    recall, both = F.col("hit") / F.col("real_n"), F.col("real_n") + F.col("pred_n")
    return per.groupBy(*by).agg(
        F.sum("real_n").alias("rows"), F.round(F.sum("hit") / F.sum("real_n"), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("real_n") > 0, recall)), 6).alias("balanced_accuracy"),
        F.round(F.avg(F.when(both > 0, 2 * F.col("hit") / both).otherwise(0.0)), 6).alias("macro_f1"),
    )


def baselines(rows: DataFrame, by: str, order: str, value: str, train: Column) -> DataFrame:
    """(real, baseline, predicted) of the test rows: the commonest training value, and each group's value before, or the commonest."""
    common = rows.filter(train).groupBy(value).agg(F.count("*").alias("n")).agg(F.max_by(value, F.struct("n", value)).alias("common"))
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    test = rows.withColumn("before", before).filter(~train).crossJoin(F.broadcast(common))
    kinds = F.explode(F.array(F.struct(F.lit("majority").alias("baseline"), F.col("common").alias("predicted")), F.struct(F.lit("persistence").alias("baseline"), F.coalesce("before", "common").alias("predicted"))))
    return test.select(by, order, F.col(value).alias("real"), kinds.alias("k")).select(by, order, "real", "k.*")


def forward_targets(panel: DataFrame, horizons: tuple[int, ...], ret: str = "ret", key: str = "tic", order: str = "day_no") -> DataFrame:
    """Return, volatility and drawdown over each horizon ahead of every row; null where the panel ends before it."""
    made = {}
    for h in horizons:
        made |= {f"fwd_return_{h}": P.forward_return(ret, key, order, h), f"fwd_volatility_{h}": P.forward_volatility(ret, key, order, h), f"fwd_drawdown_{h}": P.forward_drawdown(ret, key, order, h)}
    return panel.withColumns(made)


def daily_context(rows: DataFrame, layer: str) -> DataFrame:
    """Retrieved rows (decision_time, available_at, target, tags, kind, scores) with age, decay, intent, component scores, split and regime."""
    age = times.age_days(F.col("decision_time"), F.col("available_at"))
    parts = {
        "bm25_score": F.col("sparse_score"), "entity_match_score": F.col("entity_score"), "portfolio_weight_score": F.col("exposure_score"), "ticker_specificity_score": F.when(F.array_contains("tickers", F.col("target")), 1.0).otherwise(0.0),
        "source_reliability_score": F.col("credibility_score"), "freshness_score": F.col("recency_score"), "event_severity_score": rules.severity(F.col("event_tags"), F.col("kind")), "macro_regime_relevance_score": rules.macro_relevance(F.col("event_tags"), F.col("tickers"), F.col("kind")),
        "diversity_penalty": F.lit(0.0), "duplicate_penalty": F.lit(0.0), "final_score": F.col("final_score"),
    }
    day = F.to_date("decision_time").cast("string")
    return rows.withColumns({
        "daily_context_id": F.concat_ws(":", day, F.lit(layer), "target", F.col("rank").cast("string"), F.col("doc_id").cast("string")), "tic": F.when(F.col("target") == "PORTFOLIO", "").otherwise(F.col("target")),
        "query_intent_primary": rules.intent(F.concat_ws(" ", F.array_join("event_tags", " "), "kind"), F.lit(layer)), "age_days": F.round(age, 6), "age_bucket": times.age_bucket(age), **{f"decay_weight_{w}d": F.round(times.decay(age, w), 6) for w in (7, 30, 90)},
        "component_scores": F.struct(*[F.round(c, 6).alias(n) for n, c in parts.items()]), "document_split": times.split_of(F.col("decision_time")), "regime": times.regime_of(F.col("decision_time")),
    })


def ranked_lists(run: DataFrame) -> DataFrame:
    """The documents of each method and query in rank order."""
    return run.groupBy("method", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))


def rank_of(run: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each query's target document stands in the run; null where it wasn't retrieved."""
    return targets.join(run.select("query_id", F.col("doc_id").alias("target"), "rank"), ["query_id", "target"], "left")


def sorted_json(pairs: Column) -> Column:
    """A map as compact JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


#: Units whose changes are told as differences.
COUNTED = ("flag", "docs", "terms")


def compact_number(value: Column) -> Column:
    """A number as charts write it: with B, M or K, and fewer decimals the larger it is."""
    size = F.abs(value)
    by = F.when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).when(size >= 1e3, 1e3).otherwise(1.0)
    unit = F.when(size >= 1e9, "B").when(size >= 1e6, "M").when(size >= 1e3, "K").otherwise("")
    return F.when((size > 0) & (size < 0.01), X.fixed(value, 4)).when(size >= 10, F.concat(X.fixed(value / by, 1), unit)).otherwise(X.fixed(value, 2))


def value_label(value: Column, unit: str) -> Column:
    if unit == "ratio":
        return F.concat(X.fixed(value * 100, 1), F.lit("%"))
    if unit == "flag":
        return F.when(value > 0, "on").otherwise("off")
    if unit in ("docs", "terms"):
        return F.concat(X.fixed(value, 0), F.lit(f" {unit}"))
    if unit == "USD":
        return compact_number(value)
    if unit == "USD/share":
        return F.concat(F.lit("$"), X.fixed(value, 2))
    return F.concat(X.fixed(value, 2), F.lit(f" {unit}" if unit and unit not in ("score", "index") else ""))


def change_label(first: Column, last: Column, unit: str) -> Column:
    """A change as a share of the first value; as a difference for counted units and where the first is nothing."""
    delta, some = last - first, F.abs(first) > 1e-9
    plain = X.fixed(delta, 2, plus=True)
    return plain if unit in COUNTED else F.when(some, F.concat(X.fixed(F.when(some, delta / F.abs(first) * 100), 1, plus=True), F.lit("%"))).otherwise(plain)


def covered(rows: DataFrame, flags: list[str], by: list[str]) -> DataFrame:
    """The share of rows in each group for which each flag is set."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *[F.round(F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))), 6).alias(f"{f}_rate") for f in flags])
