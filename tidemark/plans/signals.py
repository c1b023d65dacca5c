"""Queries of signals, feeds, favourites, action data sets and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import actions as A
from tidemark.operators import signals as G
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, PANEL, corpus, panel, table
from tidemark.plans.search import POOL, has, lit, pool

FEATURES = "feats AS (SELECT doc_id, severity AS signal, (doc_id % 13 - 2) / 13.0::DOUBLE AS risk, (doc_id * 5 % 17 - 3) / 17.0::DOUBLE AS upside FROM corpus WHERE doc_id % 3 <> 1)"
MARKET = "docs AS (SELECT doc_id, body, lang, source, available_at, published_at, credibility, CASE WHEN doc_id % 9 = 0 THEN ['MARKET'] ELSE tickers END AS tickers FROM corpus)"
BASE = f"{CORPUS}, {FEATURES}, {MARKET}"
HELD = ["T1", "T3", "T5", "T8", "T11", "T12", "T20"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).select("doc_id", "body", "lang", "source", "available_at", "published_at", "credibility", "tickers")
    return d.withColumn("tickers", F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("MARKET"))).otherwise(F.col("tickers")))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).filter("doc_id % 3 <> 1").selectExpr("doc_id", "severity as signal", "(doc_id % 13 - 2) / 13.0D as risk", "(doc_id * 5 % 17 - 3) / 17.0D as upside")


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relevant(_docs(spark, sf_dir), _features(spark, sf_dir), spark.createDataFrame([(t,) for t in HELD], "ticker string"))


RELEVANT = f"{BASE}, rel AS (SELECT * FROM (SELECT d.*, signal, risk, upside, list_sort(list_filter(tickers, lambda t: list_contains({HELD!r}, t))) AS matched FROM docs d JOIN feats USING (doc_id)) WHERE len(matched) > 0 OR list_contains(tickers, 'MARKET'))"


@query("ticker_signals", f"WITH {RELEVANT}, e AS (SELECT unnest(matched) AS ticker, signal, risk, upside FROM rel), a AS (SELECT ticker, count(*) AS docs, round(avg(signal), 6) AS signal, round(avg(risk), 6) AS risk, round(avg(upside), 6) AS upside FROM e GROUP BY ticker) SELECT *, row_number() OVER (ORDER BY signal DESC, upside DESC, risk, ticker) AS rank FROM a QUALIFY rank <= 10")
def ticker_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ticker_signals(_relevant(spark, sf_dir)).select("ticker", "docs", "signal", "risk", "upside", "rank")


def _top(c: str) -> str:
    return f"SELECT '{c}' AS list, doc_id, round({c}, 6) AS score, row_number() OVER (ORDER BY round({c}, 6) DESC, available_at DESC, doc_id) AS rank FROM rel WHERE {c} > 0 QUALIFY rank <= 5"


@query("portfolio_documents", f"WITH {RELEVANT} {' UNION ALL '.join(f'({_top(c)})' for c in ('signal', 'risk', 'upside'))}")
def portfolio_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _relevant(spark, sf_dir)
    lists = [G.strongest(rows, c).select(F.lit(c).alias("list"), "doc_id", "score", "rank") for c in ("signal", "risk", "upside")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


_CUT = "TIMESTAMP '2020-01-05 12:00:00'"


def _cut() -> F.Column:
    return F.lit("2020-01-05 12:00:00").cast("timestamp_ntz")


@query("signal_candidates", f"WITH {BASE}, c AS (SELECT doc_id, available_at, round(upside + signal, 9) AS opportunity, round(risk + signal, 9) AS risk, round(signal, 9) AS other FROM docs JOIN feats USING (doc_id) WHERE signal > 0), u AS (UNPIVOT c ON opportunity, risk, other INTO NAME mode VALUE order_score) SELECT mode, doc_id, order_score, row_number() OVER (PARTITION BY mode ORDER BY order_score DESC, available_at DESC, doc_id) AS rank FROM u QUALIFY rank <= 40")
def signal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, features = _docs(spark, sf_dir).select("doc_id", "available_at"), _features(spark, sf_dir)
    newest = F.lit("9999-01-01").cast("timestamp_ntz")
    lists = [G.signal_candidates(docs, features, m, newest, 40).select(F.lit(m).alias("mode"), "doc_id", "order_score", "rank") for m in ("opportunity", "risk", "other")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@query("ticker_candidates", f"WITH {BASE}, c AS (SELECT d.doc_id, available_at, credibility, round(coalesce(signal, 0) + 0.25 * coalesce(upside, 0) + 0.25 * coalesce(risk, 0), 9) AS order_score, count(*) OVER () AS total FROM docs d LEFT JOIN feats USING (doc_id) WHERE list_has_any(tickers, ['T3', 'MARKET'])) SELECT doc_id, order_score, total, row_number() OVER (ORDER BY available_at DESC, order_score DESC, credibility DESC, doc_id) AS rank FROM c QUALIFY rank <= 50")
def ticker_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.lit("9999-01-01").cast("timestamp_ntz")
    return G.ticker_candidates(_docs(spark, sf_dir), _features(spark, sf_dir), ["T3", "MARKET"], newest, 50).select("doc_id", "order_score", "total", "rank")


@query("feature_quality", f"WITH {BASE} SELECT source, lang, count(*) AS documents, count(signal) AS with_features, round(avg(credibility), 6) AS mean_credibility, round(avg(coalesce(signal, 0)), 6) AS mean_signal FROM docs LEFT JOIN feats USING (doc_id) GROUP BY ALL")
def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quality_table(_docs(spark, sf_dir), _features(spark, sf_dir), ["source", "lang"])


@query("ticker_evidence", f"WITH {BASE}, h AS (SELECT doc_id, available_at, list_contains(tickers, 'T4') OR regexp_matches(upper(substr(body, 1, 40) || ' T' || doc_id % 31), '(^|[^A-Z0-9])T4([^A-Z0-9]|$)') AS hit FROM docs) SELECT doc_id, row_number() OVER (ORDER BY available_at DESC, doc_id) AS rank FROM h WHERE hit QUALIFY rank <= 25")
def ticker_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("title", F.concat(F.substring("body", 1, 40), F.lit(" T"), (F.col("doc_id") % 31).cast("string")))
    return G.evidence_of(d, "T4", 25).select("doc_id", "rank")


_KEYS = ("stock_text_avg_sentiment", "portfolio_text_avg_sentiment", "stock_signal_energy_count", "portfolio_signal_energy_flag", "sentiment", "", "stock_signal_credit_count_flag")


@query("feature_usefulness", f"""WITH r AS (SELECT {list(_KEYS)!r}[event_id % 7 + 1] || CASE WHEN event_id % 7 = 4 THEN '_' || event_id % 3 ELSE '' END AS f, round(value / 100, 6) AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round(sin(event_id), 6) END AS b, 0.01 AS c FROM events),
s AS (SELECT f, greatest(coalesce(a, 0), coalesce(b, 0), c) AS score, substr(f, length('stock_text_avg_') + 1) AS x, substr(f, length('portfolio_text_avg_') + 1) AS y, regexp_replace(regexp_replace(substr(f, length('stock_signal_') + 1), '_count$', ''), '_flag$', '') AS p, regexp_replace(regexp_replace(substr(f, length('portfolio_signal_') + 1), '_count$', ''), '_flag$', '') AS q FROM r WHERE f <> ''),
e AS (SELECT unnest(list_filter([f, CASE WHEN starts_with(f, 'stock_text_avg_') THEN x END, CASE WHEN starts_with(f, 'portfolio_text_avg_') THEN y END, CASE WHEN starts_with(f, 'stock_signal_') THEN 'signal_' || p END, CASE WHEN starts_with(f, 'portfolio_signal_') THEN 'signal_' || q END], lambda z: z IS NOT NULL)) AS alias, score FROM s) SELECT alias, greatest(max(score), 0)::DOUBLE AS score FROM e GROUP BY alias""")
def feature_usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    name = F.concat(F.element_at(F.array(*map(F.lit, _KEYS)), (i % 7 + 1).cast("int")), F.when(i % 7 == 4, F.concat(F.lit("_"), (i % 3).cast("string"))).otherwise(""))
    rows = table(spark, sf_dir, "events").select(name.alias("feature"), F.round(F.col("value") / 100, 6).alias("train_only_screen_score"), F.when(i % 4 != 0, F.round(F.sin(i), 6)).alias("best_abs_train_spearman"), F.lit("0.01").alias("best_abs_test_spearman"))
    return G.usefulness(rows)


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')"


@query("favourite_results", f"""WITH h AS (SELECT page_id, {_HOST} AS k FROM pages), f AS (SELECT DISTINCT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT DISTINCT k FROM h)), j AS (SELECT page_id, k, n FROM h JOIN f USING (k))
SELECT page_id, k AS favorite_site_key, CASE WHEN n = 2 THEN 'pending_removed' WHEN n = 3 THEN 'pending_added' WHEN n <= 5 THEN 'favorite' ELSE 'not_favorite' END AS favorite_status, n <= 5 AND n <> 2 AS favorite_highlight FROM j""")
def favourite_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mine = [r.site for r in G.sites(pages).orderBy("site").limit(5).collect()]
    return G.favourite_status(pages.select("page_id", "url"), mine, mine[1:2], mine[2:3]).select("page_id", "favorite_site_key", "favorite_status", "favorite_highlight")


@query("favourite_sites", f"SELECT DISTINCT {_HOST} AS site FROM pages WHERE {_HOST} <> ''")
def favourite_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sites(table(spark, sf_dir, "pages"))


_POSTED = ["jpm", "acme", "treasury", "banks and lenders"]
_REL = " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {1.0 if len(t) <= 5 else 0.5} ELSE 0 END" for t in _POSTED)


@query("post_feed", f"""WITH {POOL}, p AS (SELECT doc_id, query_id AS site, coalesce(title, '') || ' ' || excerpt AS t, doc_id % 40 AS published FROM pool), l AS (SELECT *, lower(t) AS low FROM p), s AS (SELECT doc_id, site, published, round({_REL} + 0.15 * ({' + '.join(f"contains(low, '{t}')::INT" for t in G.EVENT_TERMS)}), 6)::DOUBLE AS relevance, length(t) AS chars FROM l)
SELECT doc_id, site, relevance, chars, row_number() OVER (PARTITION BY site ORDER BY relevance DESC, published, doc_id) AS place, row_number() OVER (PARTITION BY site ORDER BY relevance DESC, published DESC, doc_id) AS feed_place FROM s""")
def post_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = pool(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("query_id").alias("site"), "title", (F.col("doc_id") % 40).alias("published_at"), F.lit("").alias("summary"), F.concat_ws(" ", F.coalesce("title", F.lit("")), "excerpt").alias("body"))
    scored = G.post_view(p).join(p.select("id", G.post_relevance(F.col("body"), _POSTED).alias("relevance")), "id")
    w = Window.partitionBy("site")
    places = {"place": F.row_number().over(w.orderBy(F.desc("relevance"), "published_at", "id")), "feed_place": F.row_number().over(w.orderBy(F.desc("relevance"), F.desc("published_at"), "id"))}
    return scored.withColumns(places).select(F.col("id").alias("doc_id"), "site", "relevance", F.col("text_char_count").cast("long").alias("chars"), "place", "feed_place")


@query("context_lines", f"""WITH {POOL} SELECT doc_id, sha256(array_to_string(['Document title: ' || coalesce(title, ''), 'Published at: ' || doc_id % 9, 'Available at: ' || doc_id % 7, 'Related tickers: ' || CASE WHEN len(tickers) > 0 THEN array_to_string(tickers, ', ') ELSE 'MARKET' END, 'Evidence scope: stock', 'Portfolio exposure: ' || doc_id % 3, 'Retrieval score: ' || rank,
  'Retrieval reasons: ' || array_to_string(list_concat(holdings, [event_tags]), ', '), 'Text excerpt: ' || excerpt], chr(10))) AS context_sha256 FROM pool""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir).withColumns({"published_at": F.col("doc_id") % 9, "available_at": F.col("doc_id") % 7, "evidence_scope": F.lit("stock"), "portfolio_weight_sum": F.col("doc_id") % 3, "final_score": F.col("rank"), "reasons": F.concat("holdings", F.array("event_tags"))})
    return p.select("doc_id", F.sha2(G.context_text(p), 256).alias("context_sha256"))


@query("statement_candidates", rf"""WITH {POOL}, a AS (SELECT doc_id, lower(coalesce(source_type, '')) AS k, lower(coalesce(title, '')) AS t, excerpt || CASE WHEN doc_id % 5 = 0 THEN ' Total Revenue' ELSE '' END AS b FROM pool),
s AS (SELECT doc_id, CASE WHEN contains(k, 'exhibit') OR contains(t, 'earnings release') THEN 5 ELSE 0 END + CASE WHEN contains(t, 'financial statements') THEN 5 ELSE 0 END + CASE WHEN contains(t, 'management') OR contains(t, 'mda') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(b, '(?i)\b(total net sales|total revenue|net income|earnings per share|gross margin)\b') THEN 5 ELSE 0 END AS points FROM a) SELECT doc_id, points FROM s WHERE points >= 5""")
def statement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("excerpt", F.when(F.col("doc_id") % 5 == 0, " Total Revenue").otherwise(""))
    return pool(spark, sf_dir).select("doc_id", G.statement_priority(F.col("source_type"), F.col("title"), body).alias("points")).filter("points >= 5")


# Actions and behaviour: orders stand for a run's steps, days and tickers come from the panel.
_TICS = ["T0", "T1", "T2", "T3"]
WIDE = f"{PANEL}, wide AS (SELECT o_orderkey % 17 AS run_key, DATE '2010-01-04' + CAST(o_orderkey // 17 * 3 AS INT) AS date, {', '.join(f'(o_orderkey * {k + 3} % 7 - 2) * 40.0::DOUBLE AS T{k}' for k in range(4))} FROM orders)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 17).alias("run_key"), F.date_add(F.lit("2010-01-04").cast("date"), (F.floor(F.col("o_orderkey") / 17) * 3).cast("int")).alias("date"), *[((F.col("o_orderkey") * (k + 3) % 7 - 2) * 40.0).alias(f"T{k}") for k in range(4)])


@query("stock_actions", f"""WITH {WIDE}, l AS (UNPIVOT wide ON {', '.join(_TICS)} INTO NAME tic VALUE act), m AS (SELECT *, lag(act) OVER (PARTITION BY run_key, tic ORDER BY date) AS prev FROM l)
SELECT run_key, CAST(m.date AS VARCHAR) AS date, m.tic, act AS teacher_action, prev AS prev_teacher_action, (abs(act) > 1e-9)::INT AS active_flag, (act >= 100)::INT AS full_buy_flag, (act < 0)::INT AS sell_flag, coalesce((abs(act - prev) > 1e-9)::INT, 0) AS changed_flag, ret FROM m LEFT JOIN panel p ON p.date = m.date AND p.tic = m.tic""")
def stock_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.stock_actions(_wide(spark, sf_dir), _TICS, ["run_key", "date"], panel(spark, sf_dir).select("date", "tic", "ret"))
    return out.withColumn("date", F.col("date").cast("string")).select("run_key", "date", "tic", "teacher_action", "prev_teacher_action", "active_flag", "full_buy_flag", "sell_flag", "changed_flag", "ret")


_CODES = ("flat__flat__flat", "buy__flat__flat", "sell__up__flat")
DAILY = "daily AS (SELECT date, count(*) AS n_tickers, round(avg(ret), 9) + 0.0 AS mean_ret FROM panel GROUP BY date)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n_tickers"), F.round(F.avg("ret"), 9).alias("mean_ret"))


@query("action_codes", f"""WITH {WIDE}, {DAILY}, c AS (SELECT run_key, date, {list(_CODES)!r}[CAST(abs(T0) // 40 AS INT) % 3 + 1] AS code, abs(T0) + abs(T1) + abs(T2) AS l1 FROM wide), p AS (SELECT *, lag(code) OVER (PARTITION BY run_key ORDER BY date) AS prev FROM c), q AS (SELECT quantile_cont(l1, 0.75) AS t FROM c WHERE date < DATE '2010-06-01')
SELECT run_key, CAST(p.date AS VARCHAR) AS date, code AS simple_action_code, prev AS prev_simple_action_code, coalesce((prev <> code)::INT, 0) AS action_code_changed_flag, (code <> 'flat__flat__flat')::INT AS action_nonflat_flag, coalesce((l1 >= t)::INT, 0) AS action_l1_high_flag, n_tickers, mean_ret FROM p CROSS JOIN q LEFT JOIN daily d ON d.date = p.date""")
def action_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wide(spark, sf_dir)
    codes = w.select("run_key", "date", F.element_at(F.array(*map(F.lit, _CODES)), ((F.abs("T0") / 40).cast("int") % 3 + 1).cast("int")).alias("simple_action_code"), (F.abs("T0") + F.abs("T1") + F.abs("T2")).alias("action_l1"))
    out = A.action_codes(codes, F.col("date") < F.lit("2010-06-01").cast("date"), _daily(spark, sf_dir))
    return out.withColumns({"date": F.col("date").cast("string"), "mean_ret": F.col("mean_ret") + 0.0}).drop("action_l1")


@query("behaviours", f"""WITH {WIDE}, {DAILY}, c AS (SELECT run_key, date, 'primitive_0' || CAST(abs(T1) // 40 AS INT) + CASE WHEN T1 < 0 THEN 3 ELSE 0 END AS pid, abs(T2) AS turn FROM wide), p AS (SELECT *, lag(pid) OVER (PARTITION BY run_key ORDER BY date) AS prev FROM c), q AS (SELECT quantile_cont(turn, 0.75) AS t FROM c WHERE date < DATE '2010-06-01')
SELECT run_key, CAST(p.date AS VARCHAR) AS date, pid AS primitive_id, coalesce((prev <> pid)::INT, 0) AS primitive_changed_flag, (pid = 'primitive_00')::INT AS primitive_00_flag, (pid IN ('primitive_03', 'primitive_04', 'primitive_05'))::INT AS bad_primitive_flag, coalesce((turn >= t)::INT, 0) AS high_turnover_flag, n_tickers FROM p CROSS JOIN q LEFT JOIN daily d ON d.date = p.date""")
def behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wide(spark, sf_dir)
    pid = F.concat(F.lit("primitive_0"), ((F.abs("T1") / 40).cast("int") + F.when(F.col("T1") < 0, 3).otherwise(0)).cast("string"))
    out = A.behaviours(w.select("run_key", "date", pid.alias("primitive_id"), F.abs("T2").alias("turnover_wmean")), F.col("date") < F.lit("2010-06-01").cast("date"), _daily(spark, sf_dir))
    return out.select("run_key", F.col("date").cast("string").alias("date"), "primitive_id", "primitive_changed_flag", "primitive_00_flag", "bad_primitive_flag", "high_turnover_flag", "n_tickers")


@query("feature_scoreboard", """WITH a AS (SELECT 'f' || p_partkey AS feature, p_partkey % 7 / 7.0::DOUBLE AS s, p_partkey % 5 AS fam, (p_partkey % 4 = 0)::INT AS prov FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT 'f' || p_partkey AS feature, p_partkey % 11 / 11.0::DOUBLE AS s, p_partkey % 6 AS fam, (p_partkey % 8 = 0)::INT AS prov FROM part WHERE p_partkey % 3 <> 1),
j AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.fam, b.fam) AS feature_family, coalesce(a.prov, b.prov) AS prov, coalesce(a.s, 0) AS x, coalesce(b.s, 0) AS y FROM a FULL JOIN b ON a.feature = b.feature), k AS (SELECT *, round(CASE WHEN prov = 1 THEN (x + y) * 0.35 ELSE x + y END, 9) AS semantic_score, round(x + y, 9) AS combined_score FROM j)
SELECT feature, feature_family, combined_score, semantic_score FROM k""")
def feature_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")

    def scores(n: int, left_out: int, families: int, every: int) -> DataFrame:
        return p.filter(k % 3 != left_out).select(F.concat(F.lit("f"), k.cast("string")).alias("feature"), (k % n / float(n)).alias("weighted_stable_score"), (k % families).alias("feature_family"), (k % every == 0).cast("int").alias("is_provenance_like"), F.lit(1.0).alias("nonzero_rate"), F.lit(1.0).alias("std"))

    out = A.scoreboard(scores(7, 0, 5, 4), scores(11, 1, 6, 8))
    return out.select("feature", "feature_family", F.round("combined_score", 9).alias("combined_score"), F.round("semantic_score", 9).alias("semantic_score"))


@query("varying_features", f"WITH {PANEL}, t AS (SELECT day_no, ret, value, 5 AS fixed, CASE WHEN day_no < 3 THEN day_no END AS rare FROM panel WHERE day_no <= 200), u AS (SELECT 'ret' AS feature, count(ret) AS v, count(DISTINCT ret) AS d FROM t UNION ALL SELECT 'value', count(value), count(DISTINCT value) FROM t UNION ALL SELECT 'day_no', count(day_no), count(DISTINCT day_no) FROM t UNION ALL SELECT 'fixed', count(fixed), count(DISTINCT fixed) FROM t UNION ALL SELECT 'rare', count(rare), count(DISTINCT rare) FROM t) SELECT feature, v AS \"values\", d AS \"distinct\" FROM u WHERE v >= 100 AND d > 1")
def varying_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select("tic", "day_no", "ret", F.col("value").cast("double").alias("value"), F.lit(5).alias("fixed"), F.when(F.col("day_no") < 3, F.col("day_no")).alias("rare"))
    return A.varying(p, F.col("day_no") <= 200, 100)


_GROUPS, _ALLOWED = ["lang", "source"], ["s0", "s1", "s2", "s3"]
COMPARED = """cmp0 AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN '' ELSE source END AS source, CASE WHEN doc_id % 12 = 0 THEN 'timeout' END AS error, CASE doc_id % 3 WHEN 0 THEN 'positive' ELSE 'mixed' END AS gd, CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN NULL ELSE 'mixed' END AS pd,
  list_sort(list_distinct(list_filter(['s' || doc_id % 4, 's' || doc_id % 6], lambda x: x IN ('s0', 's1', 's2', 's3')))) AS g, CASE WHEN doc_id % 7 = 0 THEN [] ELSE list_sort(list_distinct(list_filter(['s' || doc_id % 5, 's' || doc_id % 3], lambda x: x IN ('s0', 's1', 's2', 's3')))) END AS p, severity AS gr, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE credibility END AS pr FROM corpus),
cmp1 AS (SELECT *, coalesce((gd = pd)::INT, 0) AS direction_match, CASE WHEN len(p) > 0 THEN len(list_intersect(g, p)) / len(p)::DOUBLE WHEN len(g) = 0 THEN 1.0 ELSE 0.0 END AS pp, CASE WHEN len(g) > 0 THEN len(list_intersect(g, p)) / len(g)::DOUBLE ELSE 1.0 END AS rr FROM cmp0),
cmp AS (SELECT *, round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END, 6) AS signal_f1, round(abs(coalesce(gr, 0) - coalesce(pr, 0)), 6) AS abs_error_risk FROM cmp1)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    s = lambda n: F.concat(F.lit("s"), (i % n).cast("string"))
    rows = corpus(spark, sf_dir).select(
        "doc_id", "lang", F.when(i % 10 == 0, "").otherwise(F.col("source")).alias("source"), F.when(i % 12 == 0, "timeout").alias("error"), F.when(i % 3 == 0, "positive").otherwise("mixed").alias("gold_direction"),
        F.when(i % 4 == 0, "positive").when(i % 4 != 1, "mixed").alias("predicted_direction"), F.array(s(4), s(6)).alias("gold_signals"), F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(s(5), s(3))).alias("predicted_signals"),
        F.col("severity").alias("gold_risk"), F.when(i % 8 != 0, F.col("credibility")).alias("predicted_risk"),
    )
    return A.label_comparison(rows, _ALLOWED, ["risk"])


@query("label_comparison", f"WITH {CORPUS}, {COMPARED} SELECT doc_id, direction_match, array_to_string(list_sort(list_filter(g, lambda x: NOT list_contains(p, x))), '|') AS missing_signals, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(g, x))), '|') AS extra_signals, round(pp, 6) AS signal_precision, round(rr, 6) AS signal_recall, signal_f1, abs_error_risk FROM cmp")
def label_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("doc_id", "direction_match", "missing_signals", "extra_signals", "signal_precision", "signal_recall", "signal_f1", "abs_error_risk")


_GOOD = ", ".join(f"round(coalesce(avg({m}) FILTER (WHERE error IS NULL), 0), 6) AS {m}" for m in ("direction_match", "signal_f1", "abs_error_risk"))


@query("comparison_summary", f"WITH {CORPUS}, {COMPARED}, k AS (SELECT 'all' AS \"group\", 'all' AS key, * FROM cmp UNION ALL SELECT 'lang', coalesce(nullif(lang, ''), 'missing'), * FROM cmp UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'missing'), * FROM cmp) SELECT \"group\", key, count(*) AS rows, count(*) FILTER (WHERE error IS NULL) AS successful_rows, {_GOOD} FROM k GROUP BY \"group\", key")
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.comparison_summary(_compared(spark, sf_dir), _GROUPS, ["direction_match", "signal_f1", "abs_error_risk"])


@query("run_summary", f"WITH {CORPUS}, r AS (SELECT doc_id % 23 AS query_id, doc_id % 150 AS doc_id, available_at, TIMESTAMP '2020-01-04' AS cutoff FROM corpus), q AS (SELECT query_id, count(*) AS n, count_if(available_at > cutoff) AS late FROM r GROUP BY query_id) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS query_count, CAST(sum(late) AS BIGINT) AS leakage_rows, min(n) AS min_rows_per_query, max(n) AS max_rows_per_query, (SELECT count(DISTINCT doc_id) FROM r) AS unique_docs FROM q")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_summary(corpus(spark, sf_dir).select((F.col("doc_id") % 23).alias("query_id"), (F.col("doc_id") % 150).alias("doc_id"), "available_at", F.lit("2020-01-04").cast("timestamp_ntz").alias("cutoff")))


@query("field_counts", f"WITH {POOL} SELECT field, coalesce(nullif(value, ''), 'missing') AS value, count(*) AS n FROM (SELECT unnest(['source_type', 'intent', 'source_scope']) AS field, unnest([source_type, intent, source_scope]) AS value FROM pool) GROUP BY ALL")
def field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counts(pool(spark, sf_dir), ["source_type", "intent", "source_scope"])


@query("ticker_date_ranges", f"WITH {CORPUS} SELECT tickers[1] AS ticker, count(*) AS docs, CAST(min(published_at) AS VARCHAR) AS first, CAST(max(published_at) AS VARCHAR) AS last FROM corpus GROUP BY 1")
def ticker_date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.date_ranges(corpus(spark, sf_dir)).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})
