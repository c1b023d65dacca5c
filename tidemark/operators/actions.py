"""Data sets of a trader's actions and behaviour beside text features, and what summaries of runs and label comparisons say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Primitives that go badly, and the code of doing nothing.
BAD_PRIMITIVES = ("primitive_03", "primitive_04", "primitive_05")
FLAT = "flat__flat__flat"


def one_row_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, whose keys must not repeat: a repeated key is an error when the rows are read."""
    again = F.count("*").over(Window.partitionBy(*keys)) > 1
    return rows.withColumn("again_", again).filter(F.when(F.col("again_"), F.raise_error(F.lit(f"repeated key {keys}"))).otherwise(F.lit(True))).drop("again_")


def changed(value: str, keys: list[str], order: str) -> tuple[Column, Column]:
    """The value before, and whether there is one and it differs."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return before, F.coalesce((before != F.col(value)).cast("int"), F.lit(0))


def stock_actions(wide: DataFrame, tickers: list[str], ids: list[str], panel: DataFrame) -> DataFrame:
    """A row for each action of each ticker, with what came before it and its flags, beside the panel's columns of that day."""
    rows = wide.unpivot([*ids], [t for t in tickers if t in wide.columns], "tic", "teacher_action")
    before = F.lag("teacher_action").over(Window.partitionBy("run_key", "tic").orderBy("date"))
    rows = rows.withColumn("prev_teacher_action", before)
    action, prev = F.col("teacher_action"), F.col("prev_teacher_action")
    flag = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    rows = rows.withColumns({
        "active_flag": flag(F.abs(action) > 1e-9), "full_buy_flag": flag(action >= 100), "sell_flag": flag(action < 0), "changed_flag": flag(F.abs(action - prev) > 1e-9),
    })
    return rows.join(one_row_each(panel, ["date", "tic"]), ["date", "tic"], "left")


def above_train(rows: DataFrame, column: str, train: Column, share: float) -> Column:
    """Whether a value reaches the quantile of the training rows, which a one-row table brings."""
    return F.coalesce((F.col(column) >= F.col("threshold_")).cast("int"), F.lit(0))


def with_train_quantile(rows: DataFrame, column: str, train: Column, share: float, flag: str) -> DataFrame:
    threshold = rows.filter(train).agg(F.percentile(column, share).alias("threshold_"))
    return rows.crossJoin(F.broadcast(threshold)).withColumn(flag, above_train(rows, column, train, share)).drop("threshold_")


def action_codes(codes: DataFrame, train: Column, daily: DataFrame) -> DataFrame:
    before, flag = changed("simple_action_code", ["run_key"], "date")
    rows = codes.withColumns({"prev_simple_action_code": before, "action_code_changed_flag": flag, "action_nonflat_flag": (F.col("simple_action_code") != FLAT).cast("int")})
    return with_train_quantile(rows, "action_l1", train, 0.75, "action_l1_high_flag").join(one_row_each(daily, ["date"]), "date", "left")


def behaviours(rows: DataFrame, train: Column, daily: DataFrame) -> DataFrame:
    before, flag = changed("primitive_id", ["run_key"], "date")
    own = {f"{p}_flag": (F.col("primitive_id") == p).cast("int") for p in ("primitive_00", "primitive_04", "primitive_05")}
    rows = rows.withColumns({"prev_primitive_id": before, "primitive_changed_flag": flag, **own, "bad_primitive_flag": F.col("primitive_id").isin(*BAD_PRIMITIVES).cast("int")})
    return with_train_quantile(rows, "turnover_wmean", train, 0.75, "high_turnover_flag").join(one_row_each(daily, ["date"]), "date", "left")


def scoreboard(action: DataFrame, behaviour: DataFrame) -> DataFrame:
    """Features of either table by their scores in both; those that only say where a text is from count 0.35."""
    meta = ["feature_family", "is_provenance_like", "nonzero_rate", "std"]
    a = action.select("feature", F.col("weighted_stable_score").alias("action_weighted_score"), F.struct(*meta).alias("a_meta"))
    b = behaviour.select("feature", F.col("weighted_stable_score").alias("behavior_weighted_score"), F.struct(*meta).alias("b_meta"))
    rows = a.join(b, "feature", "full").withColumn("meta", F.coalesce("a_meta", "b_meta")).na.fill(0.0, ["action_weighted_score", "behavior_weighted_score"])
    both = F.col("action_weighted_score") + F.col("behavior_weighted_score")
    rows = rows.select("feature", "meta.*", "action_weighted_score", "behavior_weighted_score", both.alias("combined_score"))
    rows = rows.withColumn("semantic_score", F.when(F.col("is_provenance_like") == 1, F.col("combined_score") * 0.35).otherwise(F.col("combined_score")))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("semantic_score"), F.desc("combined_score"), F.asc("feature"))))


def varying(rows: DataFrame, train: Column, least: int = 30) -> DataFrame:
    """(feature, values, distinct) of numeric columns with at least `least` training values that aren't all the same."""
    names = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short")]
    found = rows.filter(train).agg(*[F.count(c).alias(f"{c}:n") for c in names], *[F.count_distinct(c).alias(f"{c}:d") for c in names])
    per = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}:n`").alias("values"), F.col(f"`{c}:d`").alias("distinct")) for c in names]))
    return found.select(per.alias("x")).select("x.*").filter((F.col("values") >= least) & (F.col("distinct") > 1))


def is_numeric_feature(name: str) -> bool:
    """Whether a missing value of a column counts 0 and not as an empty text."""
    return name.endswith(("_count", "_flag", "_score", "_days")) or name.startswith(("stock_text_", "portfolio_text_")) or "_avg_" in name or "_max_" in name


def filled(rows: DataFrame) -> DataFrame:
    """Missing features as 0 or as an empty text, by the columns' names."""
    numbers = [c for c in rows.columns if is_numeric_feature(c)]
    return rows.fillna(0, numbers).fillna("", [c for c in rows.columns if c not in numbers])


def label_comparison(rows: DataFrame, allowed: list[str], numbers: list[str]) -> DataFrame:
    """Teacher's and predicted labels side by side: whether directions agree, signals missing and extra, their precision, recall and F1, absolute errors."""
    known = F.array(*map(F.lit, allowed))
    gold, found = (F.array_sort(F.array_intersect(c, known)) for c in ("gold_signals", "predicted_signals"))
    both = F.size(F.array_intersect(gold, found))
    precision = F.when(F.size(found) > 0, both / F.size(found)).otherwise((F.size(gold) == 0).cast("double"))
    recall = F.when(F.size(gold) > 0, both / F.size(gold)).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    error = lambda n: F.round(F.abs(F.coalesce(F.col(f"gold_{n}"), F.lit(0.0)) - F.coalesce(F.col(f"predicted_{n}"), F.lit(0.0))), 6)
    return rows.withColumns({
        "direction_match": F.coalesce((F.col("gold_direction") == F.col("predicted_direction")).cast("int"), F.lit(0)), "missing_signals": F.array_join(F.array_except(gold, found), "|"), "extra_signals": F.array_join(F.array_except(found, gold), "|"),
        "signal_precision": F.round(precision, 6), "signal_recall": F.round(recall, 6), "signal_f1": F.round(f1, 6), **{f"abs_error_{n}": error(n) for n in numbers},
    })


def comparison_summary(rows: DataFrame, groups: list[str], measures: list[str]) -> DataFrame:
    """(group, key): rows, those without an error, and means over these; overall and by each grouping column, in one pass."""
    keyed = rows.select("*", F.explode(F.array(F.struct(F.lit("all").alias("group"), F.lit("all").alias("key")), *[F.struct(F.lit(g).alias("group"), F.coalesce(F.nullif(F.col(g).cast("string"), F.lit("")), F.lit("missing")).alias("key")) for g in groups])).alias("g"))
    good = F.coalesce("error", F.lit("")) == ""
    return keyed.groupBy("g.group", "g.key").agg(F.count("*").alias("rows"), F.count_if(good).alias("successful_rows"), *[F.round(F.coalesce(F.avg(F.when(good, F.col(m))), F.lit(0.0)), 6).alias(m) for m in measures])


def run_summary(rows: DataFrame) -> DataFrame:
    """One row: rows, documents, queries, rows that were not available by their cutoff, fewest and most rows of a query."""
    by = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("available_at") > F.col("cutoff")).alias("late"))
    docs = rows.agg(F.count_distinct("doc_id").alias("unique_docs"))
    return by.agg(F.sum("n").alias("rows"), F.count("*").alias("query_count"), F.sum("late").alias("leakage_rows"), F.min("n").alias("min_rows_per_query"), F.max("n").alias("max_rows_per_query")).crossJoin(F.broadcast(docs))


def counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass; an empty value is missing."""
    said = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("missing")).alias("value")) for c in columns])
    return rows.select(F.explode(said).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def date_ranges(rows: DataFrame) -> DataFrame:
    """Documents of each ticker that comes first in its document, and their first and last date."""
    return rows.select(F.get("tickers", F.lit(0)).alias("ticker"), "published_at").filter("ticker IS NOT NULL AND ticker <> ''").groupBy("ticker").agg(F.count("*").alias("docs"), F.min("published_at").alias("first"), F.max("published_at").alias("last"))


def eval_seed(contexts: DataFrame, features: DataFrame, per_kind: int) -> DataFrame:
    """At most `per_kind` contexts of each source type, one a document, latest split and intent and best score first, with their features if any."""
    order = [F.desc("split"), F.desc("intent"), F.desc("final_score"), F.asc("age_days"), F.asc("context_id")]
    once = contexts.withColumn("own", F.row_number().over(Window.partitionBy("source_type", "doc_id").orderBy(*order))).filter("own = 1")
    rows = once.withColumn("place", F.row_number().over(Window.partitionBy("source_type").orderBy(*order))).filter(F.col("place") <= per_kind).drop("own")
    seed = F.concat(F.lit("source_quality:"), F.col("source_type"), F.lit(":"), F.lpad(F.col("place").cast("string"), 3, "0"))
    return rows.join(features, "context_id", "left").withColumn("eval_id", seed)


def adjudication(compared: DataFrame, seeds: DataFrame, predictions: DataFrame, score: str, stratum: str, size: int, least: int) -> DataFrame:
    """The rows most in dispute: `least` of each stratum, then the highest scores up to `size`, beside their seeds and predictions."""
    order = [F.desc(score), F.asc("teacher_id")]
    own = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    turn = [F.asc(F.col("own") > least), F.asc(F.when(F.col("own") <= least, F.col(stratum))), *order]
    rows = compared.withColumn("own", own).orderBy(*turn).limit(size).withColumn("rank", F.row_number().over(Window.orderBy(*turn))).drop("own")
    return rows.join(seeds, "teacher_id", "left").join(predictions, "teacher_id", "left")


def informative_series(points: DataFrame, kind: str = "kind", most_zero: float = 0.985) -> DataFrame:
    """Series (series, kind, value) that aren't all zero; of text series those with fewer zeros than the bound."""
    zero = F.avg((F.coalesce("value", F.lit(0.0)) == 0).cast("double"))
    return points.groupBy("series", kind).agg(F.count("*").alias("points"), F.round(zero, 6).alias("zero_share")).filter((F.col("zero_share") < 1) & ((F.col(kind) != "text") | (F.col("zero_share") < most_zero)))


def scaled(value: Column, unit: Column) -> Column:
    """Counts on a logarithmic scale."""
    return F.when(unit.isin("docs", "terms"), F.log1p(F.greatest(value, F.lit(0.0)))).otherwise(value)


def text_features(columns: list[str]) -> list[str]:
    """The columns of a panel that come from texts."""
    return sorted(c for c in columns if c.startswith(("stock_text_", "stock_signal_", "portfolio_text_", "portfolio_signal_")))


def lean_features(relations: DataFrame, correlations: DataFrame, portfolio: int = 6, stock: int = 6, most: float = 0.95) -> list[str]:
    """Text features that vary and say more than where a text is from, best first, none of them nearly a copy of one before; 6 and 6.

    relations has a row a feature; correlations (a, b, spearman) a row a pair of features. Both are small: there are as many as columns.
    """
    rows = relations.filter("train_std > 0 AND is_provenance_like = 0 AND NOT endswith(feature, '_flag') AND train_nonzero_rate < 0.999")
    near = {frozenset((r.a, r.b)) for r in correlations.filter(F.abs("spearman") >= most).select("a", "b").collect()}
    out: list[str] = []
    for prefix, least, n in (("portfolio_", 0.01, portfolio), ("stock_", 0.005, stock)):
        own = rows.filter(F.col("feature").startswith(prefix) & (F.col("train_nonzero_rate") >= least)).orderBy(F.desc("train_only_screen_score"), F.desc("best_abs_train_spearman"), "feature")
        kept: list[str] = []
        for r in own.select("feature").collect():
            if not any(frozenset((r.feature, k)) in near for k in kept):
                kept.append(r.feature)
        out += kept[:n]
    return out
