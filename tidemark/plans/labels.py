"""Queries of label rules and crawl candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import portfolio, rules
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, DECISIONS, PANEL, corpus, decisions, panel, table

POOL = "pool AS (SELECT doc_id % 25 AS query_id, doc_id % 300 AS doc_id, doc_id AS line, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '7' ELSE CAST(doc_id % 4 AS VARCHAR) END AS label, CASE WHEN doc_id % 2 = 0 THEN 1 END AS existing FROM documents), lv AS (SELECT *, coalesce(nullif(trim(label), ''), CAST(existing AS VARCHAR)) AS value, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY line) AS again FROM pool), li AS (SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN value NOT IN ('0', '1', '2', '3') THEN 'invalid' WHEN again > 1 THEN 'duplicate' END AS issue FROM lv)"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id % 25 as query_id", "doc_id % 300 as doc_id", "doc_id as line", "case doc_id % 5 when 0 then '' when 1 then '7' else cast(doc_id % 4 as string) end as label", "case when doc_id % 2 = 0 then 1 end as existing")


@query("label_export", f"WITH {POOL} SELECT query_id, doc_id, CAST(value AS INT) AS relevance FROM li WHERE issue IS NULL")
def label_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.export_labels(_pool(spark, sf_dir), fallback=True)[0]


@query("label_export_issues", f"WITH {POOL} SELECT query_id, doc_id, line, issue FROM li WHERE issue IS NOT NULL")
def label_export_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.export_labels(_pool(spark, sf_dir), fallback=True)[1]


_FACING = "CASE " + " ".join(f"WHEN regexp_matches(k, '{'|'.join(w)}') THEN '{r}'" for w, r in rules.ORIENTATIONS) + " ELSE 'neutral' END"
_KEYS = ("risk_score", "eps_revision", "doc_count", "upside", "vix_vol")


@query("chart_tones", f"WITH s AS (SELECT event_id, {list(_KEYS)!r}[event_id % 5 + 1] AS k, round(sin(event_id) / 5, 6) AS ch FROM events), f AS (SELECT *, {_FACING} AS facing FROM s) SELECT event_id, facing, CASE WHEN abs(ch) < 0.06 THEN 'neutral' WHEN facing = 'high_bad' THEN CASE WHEN ch < 0 THEN 'positive' ELSE 'warning' END WHEN facing = 'low_bad' THEN CASE WHEN ch > 0 THEN 'positive' ELSE 'warning' END WHEN ch > 0 THEN 'positive' ELSE 'neutral' END AS tone FROM f")
def chart_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", rules.first_rule(key, rules.ORIENTATIONS, "neutral").alias("facing"), F.round(F.sin("event_id") / 5, 6).alias("change"))
    return rows.select("event_id", "facing", L.change_tone(F.col("facing"), F.col("change")).alias("tone"))


@query("direction_accuracy", f"""WITH {PANEL}, d AS (SELECT tic, ret, CASE WHEN day_no % 40 = 0 THEN 'missing' WHEN ret >= 0.005 THEN 'positive' WHEN ret <= -0.005 THEN 'negative' ELSE 'neutral' END AS realised, CASE day_no % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'mixed' ELSE 'negative' END AS predicted FROM panel),
m AS (SELECT *, CASE WHEN realised = 'missing' THEN NULL WHEN predicted = 'mixed' THEN realised <> 'neutral' ELSE predicted = realised END AS match FROM d) SELECT tic, predicted, count(*) AS n, round(avg(CAST(match AS INT)), 6) AS accuracy, round(avg(ret), 8) + 0.0 AS mean_abnormal, round(avg(abs(ret)), 8) AS mean_size FROM m GROUP BY ALL""")
def direction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    realised = L.return_direction(F.when(F.col("day_no") % 40 != 0, F.col("ret")), 0.005)
    predicted = F.when(F.col("day_no") % 3 == 0, "positive").when(F.col("day_no") % 3 == 1, "mixed").otherwise("negative")
    rows = p.select("tic", predicted.alias("predicted"), L.direction_match(predicted, realised).alias("match"), F.col("ret").alias("abnormal"))
    return L.event_summary(rows, ["tic", "predicted"])


@query("provenance_share", "SELECT doc_id, round((CAST(trim(text) <> '' AS INT) + CAST(lang <> 'en' AS INT) + 1) / 3.0, 6) AS share FROM documents")
def provenance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("other", F.when(F.col("lang") != "en", F.col("lang")))
    return d.select("doc_id", F.round(L.provenance(["text", "other", "doc_id"]), 6).alias("share"))


@query("link_scores", r"""WITH u AS (SELECT page_id, lower(url) AS u, 'annual report' AS anchor FROM pages), v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN u || '/a.pdf' WHEN 1 THEN 'https://x.example/2020/03/note' WHEN 2 THEN 'https://x.example/news/2019/' ELSE u END AS u, anchor FROM u)
SELECT page_id, CASE WHEN regexp_matches(u, '\.pdf($|\?)') THEN 12 ELSE 0 END + CASE WHEN regexp_matches(u, '(19|20)\d{2}[/-]?\d{2}') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(u, '/(19|20)\d{2}/?$') THEN 6 ELSE 0 END + CASE WHEN contains(u || ' ' || anchor, 'report') THEN 2 ELSE 0 END + CASE WHEN contains(u || ' ' || anchor, 'example') THEN 2 ELSE 0 END AS score FROM v""")
def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.lower("url")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(u, F.lit("/a.pdf"))).when(F.col("page_id") % 4 == 1, "https://x.example/2020/03/note").when(F.col("page_id") % 4 == 2, "https://x.example/news/2019/").otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", L.link_score(url, F.lit("annual report"), ["report", "example"]).alias("score"))


@query("page_rejects", "WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 404 ELSE 200 END AS status, CASE page_id % 7 WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS ct, CASE page_id % 7 WHEN 3 THEN NULL WHEN 4 THEN DATE '1999-01-01' ELSE DATE '2015-01-01' END AS published, page_id % 7 * 30 AS words FROM pages) SELECT page_id, CASE WHEN status NOT BETWEEN 200 AND 399 THEN 'bad_status' WHEN contains(ct, 'pdf') THEN 'pdf' WHEN NOT contains(ct, 'html') THEN 'not_html' WHEN published IS NULL THEN 'no_date' WHEN NOT year(published) BETWEEN 2010 AND 2023 THEN 'out_of_range' WHEN words < 170 THEN 'too_short' END AS reject_reason FROM p")
def page_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "if(page_id % 7 = 0, 404, 200) as status", "case page_id % 7 when 1 then 'application/pdf' when 2 then 'text/plain' else 'text/html; charset=utf-8' end as content_type", "case page_id % 7 when 3 then null when 4 then date'1999-01-01' else date'2015-01-01' end as published", "page_id % 7 * 30 as words")
    return p.select("page_id", L.reject_reason(p, 2010, 2023, 170).alias("reject_reason"))


@query("year_archives", "SELECT n_name AS source, y AS year, 'https://' || lower(n_name) || '.example' || replace(p, '{year}', CAST(y AS VARCHAR)) AS url FROM nation, unnest(range(2018, 2022)) AS t(y), unnest(['/news/{year}', '/archive?y={year}']) AS u(p)")
def year_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example")).alias("base_url"))
    return L.year_pages(sources, 2018, 2021, ["/news/{year}", "/archive?y={year}"])


@query("overlapping_blocks", "WITH b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 30 AS t FROM orders) SELECT o_orderkey FROM b WHERE f <= DATE '1996-06-30' AND t >= DATE '1996-06-01'")
def overlapping_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("from_day"), F.date_add(F.to_date("o_orderdate"), 30).alias("to_day"))
    return L.overlapping(b, F.lit("1996-06-01").cast("date"), F.lit("1996-06-30").cast("date")).select("o_orderkey")


@query("typeahead", "SELECT p_name AS query, CASE WHEN starts_with(lower(p_name), 'p') THEN 2 ELSE 1 END AS score FROM part WHERE contains(lower(p_name), 'p') ORDER BY score DESC, query LIMIT 6")
def typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.typeahead(table(spark, sf_dir, "part").select(F.col("p_name").alias("query")), "p")


@query("feed_relevance", f"WITH {CORPUS}, {DECISIONS} SELECT query_id, doc_id, round(least(1.0, list_sum(list_transform([1, 2, 3], lambda i: CASE WHEN list_contains(tickers, holdings[i]) OR regexp_matches(body, '(^|[^A-Za-z0-9])' || holdings[i] || '([^A-Za-z0-9]|$)') THEN sizes[i] ELSE 0 END))), 6) AS relevance FROM corpus JOIN decisions ON doc_id % 40 = query_id")
def feed_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("query_id", F.col("doc_id") % 40).join(decisions(spark, sf_dir).select("query_id", "weights"), "query_id")
    return rows.select("query_id", "doc_id", F.round(L.relevance_of(F.col("body"), F.col("tickers"), F.col("weights")), 6).alias("relevance"))


def _first(column: str, table_: tuple, default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({column}, '{x}')" for x in w) + f" THEN '{r}'" for w, r in table_) + f" ELSE {default} END"


_SAID = ("Annual Report 2019", "Quarterly earnings and outlook", "press: merger talks", "SEC filing, litigation", "investor day", "rates and yield", "dividend, oil demand", "nothing")
SAID = f"said AS (SELECT doc_id, lower(concat_ws(' ', text, {list(_SAID)!r}[doc_id % 8 + 1])) AS t, CASE WHEN doc_id % 2 = 0 THEN 'portfolio' ELSE 'stock' END AS layer FROM documents)"


@query("text_rules", f"""WITH {SAID} SELECT doc_id, {_first("t", rules.DOCUMENT_TYPES, "'company_official_archive'")} AS document_type, {_first("t", rules.INTENTS, "CASE WHEN layer = 'portfolio' THEN 'macro_growth' ELSE 'company_risk' END")} AS intent,
  array_to_string(list_sort(list_filter(['company_official', {', '.join(_first("t", (r,), 'NULL') for r in rules.EVENT_TAGS)}], lambda x: x IS NOT NULL)), '|') AS event_tags, array_to_string(list_filter({list(rules.RISK_TERMS)!r}, lambda x: contains(t, x)), '|') AS risk_terms FROM said""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with a phrase after each so that rules hold."""
    t = F.concat_ws(" ", "body", F.element_at(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % 8 + 1).cast("int")))
    layer = F.when(F.col("doc_id") % 2 == 0, "portfolio").otherwise("stock")
    return corpus(spark, sf_dir).select("doc_id", rules.first_rule(t, rules.DOCUMENT_TYPES, "company_official_archive").alias("document_type"), rules.intent(t, layer).alias("intent"), F.array_join(rules.all_rules(t, rules.EVENT_TAGS, "company_official"), "|").alias("event_tags"), F.array_join(rules.risk_terms(t), "|").alias("risk_terms"))


def _card_sql(name: str) -> str:
    parts = []
    for m in dict.fromkeys(r[0] for r in rules.CARDS[name]):
        tests = {"within": "abs({m}) < {b}", "else": "TRUE"}
        parts.append(f"CASE WHEN {m} IS NULL THEN 0 " + " ".join("WHEN " + tests.get(t, "{m} {t} {b}").format(m=m, t=t, b=b) + f" THEN {p}" for _, p, t, b in (r for r in rules.CARDS[name] if r[0] == m)) + " ELSE 0 END")
    return f"round({' + '.join(parts)}, 6)"


_RANGE = {"real_10y_yield": (0.0, 3.0), "investment_grade_credit_spread": (0.8, 1.2), "fed_funds_rate": (2.0, 4.0), "payrolls_3m_avg": (20000.0, 250000.0), "unemployment_3m_change": (-0.2, 0.8), "retail_sales_yoy": (-2.0, 6.0), "ism_new_orders": (44.0, 12.0), "sp500_earnings_revision_3m": (-0.05, 0.1), "dxy_yoy": (-6.0, 14.0), "vix": (10.0, 25.0), "wti_yoy": (-40.0, 90.0)}
SNAPSHOT = "snap AS (SELECT event_id, " + ", ".join(f"CASE WHEN event_id % {11 + i} = 0 THEN NULL ELSE round({lo} + {w} * ((event_id * {7 + 2 * i}) % 101) / 101.0::DOUBLE, 4) END AS {m}" for i, (m, (lo, w)) in enumerate(_RANGE.items())) + " FROM events)"
_TONE = "CASE WHEN {0} >= 0.35 THEN 'positive' WHEN {0} <= -0.35 THEN 'negative' ELSE 'neutral' END"


@query("macro_cards", f"WITH {SNAPSHOT}, c AS (SELECT event_id, {', '.join(f'{_card_sql(n)} AS {n}' for n in rules.CARDS)} FROM snap), t AS (SELECT *, {', '.join(f'{_TONE.format(n)} AS {n}_tone' for n in rules.CARDS)} FROM c), v AS (SELECT *, {' + '.join(f"CASE {n}_tone WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END" for n in rules.CARDS)} AS votes FROM t) SELECT event_id, {', '.join(f'{n}_tone' for n in rules.CARDS)}, CASE WHEN votes >= 2 THEN 'risk_on' WHEN votes <= -2 THEN 'risk_off' ELSE 'transition' END AS regime FROM v")
def macro_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    snap = e.select("event_id", *[F.when(F.col("event_id") % (11 + i) != 0, F.round(lo + w * (F.col("event_id") * (7 + 2 * i) % 101) / 101.0, 4)).alias(m) for i, (m, (lo, w)) in enumerate(_RANGE.items())])
    tones = snap.select("event_id", *[portfolio.tone(F.round(rules.card_score(n), 6)).alias(f"{n}_tone") for n in rules.CARDS])
    return tones.withColumn("regime", portfolio.regime([F.col(f"{n}_tone") for n in rules.CARDS]))


@query("document_scores", f"""WITH {CORPUS} SELECT doc_id, CASE event_tags[1] WHEN 'risk_factors' THEN 0.9 WHEN 'guidance' THEN 0.8 ELSE 0.4 END AS severity_score, CASE WHEN doc_id % 6 = 0 THEN 1.0 ELSE 0.2 END AS macro_score,
  CASE WHEN list_contains(tickers, 'T3') THEN 6.0 WHEN doc_id % 6 = 0 THEN -7.0 ELSE -10.0 END AS entity_score, CASE WHEN doc_id % 6 = 0 THEN 'official_macro' WHEN doc_id % 6 = 1 THEN 'sec_edgar' WHEN doc_id % 6 = 2 THEN 'company_ir' ELSE 'other' END AS family FROM corpus""")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 6 == 0, "official_macro_release").when(F.col("doc_id") % 6 == 2, "company_press_release").otherwise("news")
    url = F.when(F.col("doc_id") % 6 == 1, "https://www.sec.gov/x").otherwise("https://x.example")
    return corpus(spark, sf_dir).select("doc_id", rules.severity(F.col("event_tags"), kind).alias("severity_score"), rules.macro_relevance(F.col("event_tags"), F.col("tickers"), kind).alias("macro_score"), rules.entity_alignment(F.col("tickers"), F.array(F.lit("T3")), kind, F.lit(False)).alias("entity_score"), rules.source_family(kind, F.col("source"), url).alias("family"))


@query("search_scores", f"""WITH {CORPUS}, s AS (SELECT doc_id, severity AS s, credibility AS c, CAST(doc_id % 3 = 0 AS INT) AS g, CAST(doc_id % 4 = 0 AS INT) AS k, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.25 END AS i FROM corpus),
u AS (SELECT *, greatest(0, s - 0.5) + c + 0.5 * s + 0.6 * g + 0.4 * k + greatest(0, i) AS up, c + s + greatest(0, 0.5 - s) + 0.5 * k + 0.5 * g + 0.4 * k + 0.3 * g + greatest(0, -i) AS ra, s * (1 + least(0.35, 4 * 0.05)) AS cal FROM s)
SELECT doc_id, round(up, 6) AS upside, round(ra, 6) AS risk_alert, round(1 + 1.15 * cal + 0.75 * up + 0.35 * s + 0.3 * c + 2.5 * 0.05 + CASE WHEN g = 1 THEN 2.0 ELSE -1.25 END - CASE WHEN k = 1 THEN 1.25 ELSE 0 END, 6) AS opportunity, round(1 + 1.15 * cal + 0.75 * ra + 0.35 * s + 0.3 * c + 2.5 * 0.05 + CASE WHEN g = 1 THEN 0.75 ELSE 0 END, 6) AS risk FROM u""")
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.col("severity"), F.col("credibility")
    g, k = (F.col("doc_id") % 3 == 0).cast("int"), (F.col("doc_id") % 4 == 0).cast("int")
    impact = portfolio.impact(F.when(F.col("doc_id") % 3 == 0, "positive").when(F.col("doc_id") % 3 == 1, "negative").otherwise("mixed"))
    up = rules.upside({"sentiment": s - 0.5, "opportunity": c, "forward": s, "earnings_guidance": g, "capital_return": k, "impact": impact})
    alert = rules.risk_alert({"risk": c, "uncertainty": s, "sentiment": s - 0.5, "company_risk": k, "legal_regulatory": g, "margin_pressure": k, "supply_chain": g, "impact": impact})
    zero = F.lit(0.0)
    f = {"lexical": F.lit(1.0), "signal": rules.calibrated(s, F.lit(0.05)), "upside": up, "risk_alert": alert, "event": s, "credibility": c, "usefulness": F.lit(0.05), "source": zero, "entity": zero, "field": zero}
    return corpus(spark, sf_dir).select("doc_id", F.round(up, 6).alias("upside"), F.round(alert, 6).alias("risk_alert"), *[F.round(rules.search_total(f, m, g == 1, k == 1), 6).alias(m) for m in ("opportunity", "risk")])
