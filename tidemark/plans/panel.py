"""Queries of panels, events and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.operators import stats as S
from tidemark.plans.registry import query
from tidemark.plans.roles import PANEL, panel, table


def _ahead(h: int) -> str:
    return f"(PARTITION BY tic ORDER BY day_no ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"


@query("forward_return_5", f"WITH {PANEL} SELECT tic, day_no, CASE WHEN count(ret) OVER w = 5 THEN round(exp(sum(ln(1 + ret)) OVER w) - 1, 9) + 0.0 END AS fwd FROM panel WINDOW w AS {_ahead(5)}")
def forward_return_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("tic", "day_no", F.round(P.forward_return("ret", "tic", "day_no", 5), 9).alias("fwd"))


@query("forward_vol_20", f"WITH {PANEL} SELECT tic, day_no, CASE WHEN count(ret) OVER w = 20 THEN round(stddev_pop(ret) OVER w * sqrt(252), 8) END AS vol FROM panel WINDOW w AS {_ahead(20)}")
def forward_vol_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("tic", "day_no", F.round(P.forward_volatility("ret", "tic", "day_no", 20), 8).alias("vol"))


@query("forward_drawdown_20", f"""WITH {PANEL}, l AS (SELECT tic, day_no, count(ret) OVER w AS n, list(ret) OVER w AS rs FROM panel WINDOW w AS {_ahead(20)})
SELECT tic, day_no, CASE WHEN n = 20 THEN round(list_min(list_transform(range(1, 21), lambda i: list_product(list_transform(rs[1:i], lambda r: 1 + r)) / greatest(1.0, list_max(list_transform(range(1, i + 1), lambda k: list_product(list_transform(rs[1:k], lambda r: 1 + r))))) - 1)), 9) END AS fall FROM l""")
def forward_drawdown_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("tic", "day_no", F.round(P.forward_drawdown("ret", "tic", "day_no", 20), 9).alias("fall"))


@query("risk_flags", f"""WITH {PANEL}, v AS (SELECT tic, day_no, CASE WHEN count(ret) OVER w = 20 THEN stddev_pop(ret) OVER w END AS vol FROM panel WINDOW w AS {_ahead(20)}),
q AS (SELECT quantile_cont(vol, 0.75) AS q75 FROM v WHERE day_no <= 200) SELECT tic, day_no, CASE WHEN round(vol, 12) >= round(q75, 12) THEN 1 ELSE 0 END AS high_vol FROM v, q""")
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold is fitted on the first days alone."""
    v = panel(spark, sf_dir).select("tic", "day_no", (P.forward_volatility("ret", "tic", "day_no", 20) / F.sqrt(F.lit(252.0))).alias("vol"))
    q = v.filter("day_no <= 200").agg(F.percentile("vol", 0.75).alias("q75"))
    return v.crossJoin(F.broadcast(q)).select("tic", "day_no", P.train_flag(F.round("vol", 12), F.round("q75", 12)).alias("high_vol"))


EVENTS = "ev AS (SELECT o_orderkey AS id, 'T' || (o_custkey % 29) AS tic, DATE '2010-01-01' + CAST(o_orderkey % 1300 AS INT) AS event_date FROM orders)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "concat('T', cast(o_custkey % 29 as string)) as tic", "date_add(date'2010-01-01', cast(o_orderkey % 1300 as int)) as event_date")


@query("asof_first_trading_day", f"WITH {PANEL}, {EVENTS} SELECT id, CAST((SELECT min(date) FROM panel p WHERE p.tic = ev.tic AND p.date >= event_date) AS VARCHAR) AS trading_date FROM ev")
def asof_first_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_day_on_or_after(_events(spark, sf_dir), panel(spark, sf_dir)).select("id", F.col("trading_date").cast("string").alias("trading_date"))


def _window_sql(a: int, b: int, name: str) -> str:
    low = a if a != b else a - 1
    return f"round((SELECT exp(q.log_to - p.log_to) - 1 FROM lp q, lp p WHERE q.tic = e.tic AND q.day_no = e.day_no + {b} AND p.tic = e.tic AND p.day_no = e.day_no + {low}), 9) + 0.0 AS {name}"


@query("event_study_returns", f"""WITH {PANEL}, {EVENTS}, lp AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY tic ORDER BY day_no) AS log_to FROM panel),
e AS (SELECT id, ev.tic, p.day_no FROM ev JOIN panel p ON p.tic = ev.tic AND p.date = (SELECT min(date) FROM panel x WHERE x.tic = ev.tic AND x.date >= event_date))
SELECT id, {', '.join(_window_sql(a, b, n) for n, (a, b) in P.EVENT_WINDOWS.items())} FROM e""")
def event_study_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = P.window_returns(P.compounded(panel(spark, sf_dir), "tic", "day_no", "ret"), P.EVENT_WINDOWS).select("tic", "date", *P.EVENT_WINDOWS)
    return P.on_trading_days(_events(spark, sf_dir), days).select("id", *[F.round(c, 9).alias(c) for c in P.EVENT_WINDOWS])


@query("market_return", f"WITH {PANEL} SELECT CAST(date AS VARCHAR) AS date, round(avg(ret), 9) + 0.0 AS market_ret, count(ret) AS n FROM panel GROUP BY date")
def market_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.market(panel(spark, sf_dir)).select(F.col("date").cast("string").alias("date"), F.round("market_ret", 9).alias("market_ret"), "n")


@query("panel_left_join", f"""WITH {PANEL}, s AS (SELECT date, tic, sum(day_no) AS x FROM panel WHERE day_no % 3 = 0 GROUP BY ALL), f AS (SELECT date, count(*) AS y FROM panel WHERE day_no % 5 = 0 GROUP BY date)
SELECT CAST(p.date AS VARCHAR) AS date, p.tic, ret, coalesce(x, 0)::BIGINT AS x, coalesce(y, 0) AS y, CAST(x IS NOT NULL AS INT) AS has_stock_text, CAST(y IS NOT NULL AS INT) AS has_portfolio_text FROM panel p LEFT JOIN s USING (date, tic) LEFT JOIN f USING (date)""")
def panel_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    s = p.filter("day_no % 3 = 0").groupBy("date", "tic").agg(F.sum("day_no").alias("x"))
    f = p.filter("day_no % 5 = 0").groupBy("date").agg(F.count("*").alias("y"))
    return P.merge_panel(p.select("date", "tic", "ret"), s, f, ["x", "y"]).withColumn("date", F.col("date").cast("string"))


@query("rolling_text_63", f"WITH {PANEL} SELECT tic, day_no, round(sum(ret) OVER w, 9) + 0.0 AS total, round(avg(ret) OVER w, 9) + 0.0 AS mean FROM panel WINDOW w AS (PARTITION BY tic ORDER BY day_no ROWS 62 PRECEDING)")
def rolling_text_63(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("tic", "day_no", *[F.round(P.rolling("ret", "tic", "day_no", 63, m), 9).alias(n) for n, m in (("total", False), ("mean", True))])


@query("change_point", f"WITH {PANEL}, c AS (SELECT tic, day_no, day_no // 7 % 3 AS v FROM panel), x AS (SELECT *, lag(v) OVER w AS b, row_number() OVER w AS rn, lead(1) OVER w AS nx FROM c WINDOW w AS (PARTITION BY tic ORDER BY day_no)) SELECT tic, day_no, v FROM x WHERE rn = 1 OR v IS DISTINCT FROM b OR nx IS NULL")
def change_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).select("tic", "day_no", (F.floor(F.col("day_no") / 7) % 3).alias("v"))
    return P.change_points(rows, "tic", "day_no", "v").select("tic", "day_no", "v")


@query("downsample", f"WITH {PANEL}, n AS (SELECT tic, day_no, row_number() OVER (PARTITION BY tic ORDER BY day_no) - 1 AS slot, count(*) OVER (PARTITION BY tic) AS size FROM panel) SELECT tic, day_no, slot FROM n WHERE slot % CAST(ceil(size / 40.0) AS BIGINT) = 0 OR slot = size - 1")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.downsample(panel(spark, sf_dir).select("tic", "day_no"), "tic", "day_no", 40)


@query("robust_scale", f"WITH {PANEL}, q AS (SELECT tic, quantile_cont(value, 0.03) AS lo, quantile_cont(value, 0.97) AS hi FROM panel GROUP BY tic) SELECT tic, day_no, round(CASE WHEN hi > lo THEN greatest(0, least(1, (value - lo) / (hi - lo))) ELSE 0.5 END, 8) AS y, value < lo OR value > hi AS clipped FROM panel JOIN q USING (tic)")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.robust_scale(panel(spark, sf_dir), "tic", "value").select("tic", "day_no", F.round("y", 8).alias("y"), "clipped")


@query("monthly_avg", f"WITH {PANEL} SELECT tic, strftime(date, '%Y-%m') AS month, CAST(max(date) AS VARCHAR) AS date, round(avg(value), 8) AS value FROM panel GROUP BY ALL")
def monthly_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.monthly(panel(spark, sf_dir), "tic", "date", "value").select("tic", "month", F.col("date").cast("string").alias("date"), F.round("value", 8).alias("value"))


@query("linear_trend", f"WITH {PANEL} SELECT tic, round(regr_slope(value, day_no), 8) AS slope, round(regr_intercept(value, day_no), 6) AS intercept FROM panel GROUP BY tic")
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trend(panel(spark, sf_dir), "tic", "day_no", "value").select("tic", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("performance", f"""WITH {PANEL}, l AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY tic ORDER BY day_no) AS lg FROM panel), d AS (SELECT tic, exp(lg - max(lg) OVER (PARTITION BY tic ORDER BY day_no)) - 1 AS fall FROM l)
SELECT p.tic, round(avg(ret) / stddev_samp(ret) * sqrt(252), 8) AS sharpe, round(exp(sum(ln(1 + ret))) - 1, 8) AS cumulative, (SELECT round(min(fall), 8) FROM d WHERE d.tic = p.tic) AS max_drawdown FROM panel p GROUP BY p.tic""")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    both = P.performance(p, "tic", "ret").join(P.max_drawdown(p, "tic", "day_no", "ret"), "tic")
    return both.select("tic", *[F.round(c, 8).alias(c) for c in ("sharpe", "cumulative", "max_drawdown")])


@query("spearman", f"""WITH {PANEL}, r AS (SELECT tic, rank() OVER (PARTITION BY tic ORDER BY value) + (count(*) OVER (PARTITION BY tic, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY tic ORDER BY ret) + (count(*) OVER (PARTITION BY tic, ret) - 1) / 2.0 AS ry FROM panel)
SELECT tic, count(*) AS n, CASE WHEN count(*) >= 50 THEN round(corr(rx, ry), 8) END AS spearman FROM r GROUP BY tic""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spearman(panel(spark, sf_dir), ["tic"], "value", "ret").withColumn("spearman", F.round("spearman", 8))


LABELLED = "lab AS (SELECT lang, quality AS y, n_chars % 50 AS s FROM documents JOIN labels USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").selectExpr("lang", "quality as y", "n_chars % 50 as s")


@query("auc_rank_sum", f"WITH {LABELLED} SELECT a.lang, round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 8) AS auc FROM lab a JOIN lab b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang")
def auc_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.auc(_labelled(spark, sf_dir), ["lang"], "y", "s").withColumn("auc", F.round("auc", 8)).filter("auc IS NOT NULL")


@query("average_precision", f"WITH {LABELLED}, g AS (SELECT lang, s, sum(y) AS p, count(*) AS n FROM lab GROUP BY ALL), c AS (SELECT *, sum(p) OVER w / sum(n) OVER w AS pr FROM g WINDOW w AS (PARTITION BY lang ORDER BY s DESC)) SELECT lang, round(sum(pr * p) / sum(p), 8) AS average_precision FROM c GROUP BY lang")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.average_precision(_labelled(spark, sf_dir), ["lang"], "y", "s").withColumn("average_precision", F.round("average_precision", 8))


@query("target_summary", f"WITH {PANEL} SELECT tic, count(ret) AS n, round(avg(ret), 9) AS mean, round(stddev_pop(ret), 9) AS std, {', '.join(f'round(quantile_cont(ret, {p / 100}), 9) AS q{p:02d}' for p in (5, 25, 50, 75, 95))} FROM panel GROUP BY tic")
def target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.target_summary(panel(spark, sf_dir), ["tic"], "ret")
    return out.select("tic", "n", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


@query("return_correlation", f"WITH {PANEL} SELECT tic, round(corr(value, ret), 8) AS r FROM panel GROUP BY tic")
def return_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("tic").agg(F.round(S.correlation("value", "ret"), 8).alias("r"))


@query("panel_quality", f"WITH {PANEL}, x AS (SELECT tic, date, CASE WHEN day_no % 10 = 0 THEN NULL ELSE ret END AS ret FROM panel UNION ALL SELECT tic, date, ret FROM panel WHERE day_no % 7 = 0), k AS (SELECT tic, date, count(*) AS n FROM x GROUP BY ALL) SELECT (SELECT count(*) FROM x) AS rows, (SELECT sum(n - 1)::BIGINT FROM k) AS duplicate_rows, (SELECT count_if(ret IS NULL) FROM x) AS ret_missing, 0::BIGINT AS ret_infinite")
def panel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    x = p.select("tic", "date", F.when(F.col("day_no") % 10 != 0, F.col("ret")).alias("ret")).union(p.filter("day_no % 7 = 0").select("tic", "date", "ret"))
    return S.quality_counts(x, ["ret"], ["tic", "date"])
