"""Queries of feature diagnostics, screening and filings' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as D
from tidemark.plans.registry import query
from tidemark.plans.roles import PANEL, panel, table

FEATS = "fe AS (SELECT tic, day_no, ret, CAST(ret > 0 AS INT) AS y, day_no % 4 AS fold, CAST(day_no % 7 AS DOUBLE) AS a, round(value, 0) AS b, CASE WHEN day_no % 3 = 0 THEN 0.0 ELSE ret * 2 END AS c FROM panel), lo AS (SELECT y, ret, fold, feature, x FROM (UNPIVOT fe ON a, b, c INTO NAME feature VALUE x))"
_RANKS = "rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).selectExpr("tic", "day_no", "ret", "cast(ret > 0 as int) as y", "day_no % 4 as fold", "cast(day_no % 7 as double) as a", "round(value, 0) as b", "if(day_no % 3 = 0, 0.0D, ret * 2) as c")


@query("feature_relations", f"""WITH {PANEL}, {FEATS}, r AS (SELECT *, {_RANKS.format(g='feature', x='x')} AS rx, {_RANKS.format(g='feature', x='ret')} AS ry FROM lo)
SELECT feature, round(stddev_pop(x), 8) AS std, round(avg(CAST(x <> 0 AS INT)), 8) AS nonzero, round(corr(rx, ry), 8) AS spearman, round((sum(rx * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 8) AS auc FROM r GROUP BY feature""")
def feature_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.relations(_features(spark, sf_dir), ["a", "b", "c"], "ret", "y")
    return out.select("feature", *[F.round(c, 8).alias(c) for c in ("std", "nonzero", "spearman", "auc")])


@query("fold_edges", f"""WITH {PANEL}, {FEATS}, r AS (SELECT *, {_RANKS.format(g='feature, fold', x='x')} AS rx FROM lo), e AS (SELECT feature, fold, (sum(rx * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) - 0.5 AS edge FROM r GROUP BY ALL), m AS (SELECT *, avg(edge) OVER (PARTITION BY feature) AS me FROM e)
SELECT feature, round(max(me), 8) AS mean_edge, round(avg(CAST(sign(edge) = sign(me) AS INT)), 6) AS stability, count(*) AS folds FROM m GROUP BY feature""")
def fold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.fold_edges(_features(spark, sf_dir), ["a", "b", "c"], "y", "fold")
    return out.select("feature", F.round("mean_edge", 8).alias("mean_edge"), F.round("stability", 6).alias("stability"), "folds")


RECS = "rec AS (SELECT p_partkey, p_name AS feature, 'r' || (p_partkey % 40) AS root, round((p_partkey * 37 % 101) / 1000.0, 4) AS train_edge, round((p_partkey * 53 % 97) / 1000.0, 4) AS test_edge, round((p_partkey * 11 % 89) / 6.0, 4) AS coef, round((p_partkey * 17 % 83) / 200.0, 4) AS rate_change FROM part)"


@query("recommended_features", f"WITH {RECS}, s AS (SELECT *, round(train_edge + 0.5 * test_edge + 0.02 * least(coef, 10), 8) AS recommend FROM rec WHERE (train_edge >= 0.015 OR coef >= 0.05) AND abs(rate_change) <= 0.25), o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY recommend DESC, p_partkey) AS own FROM s) SELECT p_partkey, root, recommend FROM o WHERE own = 1 ORDER BY recommend DESC, p_partkey LIMIT 15")
def recommended_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as feature", "round(p_partkey * 37 % 101 / 1000.0D, 4) as train_edge", "round(p_partkey * 53 % 97 / 1000.0D, 4) as test_edge", "round(p_partkey * 11 % 89 / 6.0D, 4) as coef", "round(p_partkey * 17 % 83 / 200.0D, 4) as rate_change")
    out = D.recommended(p, F.concat(F.lit("r"), (F.col("feature") % 40).cast("string")), 15)
    return out.select(F.col("feature").alias("p_partkey"), "root", F.round("recommend", 8).alias("recommend"))


@query("metric_deltas", f"WITH {PANEL}, m AS (SELECT tic, day_no % 3 AS v, avg(ret) AS r, max(ret) AS x FROM panel GROUP BY ALL) SELECT tic, 'v' || v AS variant, round(r - max(CASE WHEN v = 0 THEN r END) OVER (PARTITION BY tic), 9) + 0.0 AS r_delta, round(x - max(CASE WHEN v = 0 THEN x END) OVER (PARTITION BY tic), 9) + 0.0 AS x_delta FROM m")
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = panel(spark, sf_dir).groupBy("tic", F.concat(F.lit("v"), (F.col("day_no") % 3).cast("string")).alias("variant")).agg(F.avg("ret").alias("r"), F.max("ret").alias("x"))
    return D.deltas(m, ["tic"], "variant", "v0", ["r", "x"]).select("tic", "variant", *[F.round(f"{c}_delta", 9).alias(f"{c}_delta") for c in ("r", "x")])


@query("screening_gate", "WITH e AS (SELECT n_nationkey AS k, n_name AS experiment, (n_nationkey * 7 % 11) / 10.0 AS sharpe, (n_nationkey * 5 % 13) / 10.0 AS cumulative, -(n_nationkey * 3 % 17) / 100.0 AS dd, (n_nationkey * 2 % 9) / 10.0 AS turnover FROM nation), b AS (SELECT * FROM e WHERE k = 4) SELECT e.experiment, e.k <> 4 AND e.sharpe > b.sharpe AND e.cumulative > b.cumulative AND abs(e.dd) <= abs(b.dd) + 0.03 AND e.turnover <= 1.25 * b.turnover AS gate FROM e, b")
def screening_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    base = n.filter("n_nationkey = 4").first().n_name
    e = n.selectExpr("n_name as experiment", "n_nationkey * 7 % 11 / 10.0D as sharpe", "n_nationkey * 5 % 13 / 10.0D as cumulative", "-(n_nationkey * 3 % 17) / 100.0D as max_drawdown", "n_nationkey * 2 % 9 / 10.0D as turnover")
    return D.passes_gate(e, base).select("experiment", "gate")


@query("financial_snapshot", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS revenue, CAST(o_custkey + 1 AS DOUBLE) AS revenue_prior, round((o_orderkey - (o_custkey + 1)) / (o_custkey + 1)::DOUBLE * 100, 2) AS revenue_change, -CAST(o_orderkey AS DOUBLE) AS income, 5.0::DOUBLE AS income_prior FROM orders")
def financial_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("Total net sales $ %,d  %,d\nNet income (loss): (%d) 5 and more", "o_orderkey", F.col("o_custkey") + 1, "o_orderkey")
    out = D.snapshot(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")), "t", {"revenue": "net sales", "income": r"net income \(loss\)"})
    return out.select("o_orderkey", "revenue", "revenue_prior", "revenue_change", "income", "income_prior")


@query("first_sentences", r"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 35)[1:3], '|') AS sentences FROM documents WHERE NOT contains(text, chr(1))")
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(D.sentences(F.col("text"), 35, 3), "|").alias("sentences"))


@query("marked_section", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN ' body ' ELSE ' body and no end' END AS part FROM documents")
def marked_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, "nothing").when(F.col("doc_id") % 3 == 1, "a BEGIN body END z").otherwise("BEGIN body and no end")
    return table(spark, sf_dir, "documents").select("doc_id", D.between(t, "BEGIN", "END").alias("part"))


@query("compact_numbers", "SELECT o_orderkey, CASE WHEN v >= 1e6 THEN printf('%.1f', v / 1e6) || 'M' WHEN v >= 1e3 THEN printf('%.1f', v / 1e3) || 'K' ELSE printf('%.2f', v) END AS label FROM (SELECT o_orderkey, CAST((o_orderkey % 3) * 999 * (o_orderkey % 7) * (o_orderkey % 501) + 0.5 AS DOUBLE) AS v FROM orders)")
def compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.compact(((k % 3) * 999 * (k % 7) * (k % 501) + 0.5).cast("double")).alias("label"))
