"""Queries of feeds, sitemaps, posts, pages and promising links, and of results' rows and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import actions as A
from tidemark.operators import pages as W
from tidemark.operators import search as S
from tidemark.operators import signals as G
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, PANEL, corpus, panel, table
from tidemark.plans.search import POOL, has, pool
from tidemark.plans.signals import BASE, _docs, _features

_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')"


@query("rss_items", "SELECT page_id, 'Item ' || u.i || ' & more' AS title, url || '?i=' || u.i AS url, CASE WHEN u.i = 1 THEN '2019-03-05T14:30:00Z' ELSE '2020-12-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') || 'T23:00:00Z' END AS published_at, 'said of ' || page_id AS summary FROM pages, unnest([1, 2]) AS u(i) WHERE page_id % 10 <> 3")
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, link = F.col("page_id"), F.replace("url", F.lit("&"), F.lit("&amp;"))
    item = lambda n, at: F.concat(F.lit(f"<item><title>  Item {n} &amp;\n more </title><link>"), link, F.lit(f"?i={n}</link><pubDate>"), at, F.lit("</pubDate><description><![CDATA[said  of "), i.cast("string"), F.lit("]]></description></item>"))
    second = F.concat(F.lit("Fri, "), F.lpad((1 + i % 28).cast("string"), 2, "0"), F.lit(" Dec 2020 18:00:00 -0500"))
    xml = F.concat(F.lit('<rss version="2.0"><channel><title>feed</title>'), item(1, F.lit("Tue, 05 Mar 2019 14:30:00 GMT")), item(2, second), F.lit("</channel></rss>"))
    return W.rss_items(table(spark, sf_dir, "pages").select("page_id", F.when(i % 10 == 3, "no feed at all").otherwise(xml).alias("xml")))


_SPOTS = ("/2020/03/05/earnings-results", "/news/2019/press-release", "/about", "/reports/annual_2018.pdf", "/investor/quarterly/q3", "/media/2031/x", "/2005/old-report.PDF?x=1")
_TYPES = ("earnings page", "press room", "annual reports", "events", "archive")
ENTRIES = f"""en AS (SELECT page_id, 'https://' || CASE WHEN page_id % 5 = 0 THEN 'other.example' WHEN page_id % 5 = 1 THEN 'sub.site.example' ELSE 'site.example' END || {list(_SPOTS)!r}[page_id % 7 + 1] AS url, CASE page_id % 3 WHEN 0 THEN '2019-07-01' WHEN 1 THEN '2020-02-03T04:05:06Z' ELSE '' END AS mod, {list(_TYPES)!r}[page_id % 5 + 1] AS source_type FROM pages),
ent AS (SELECT page_id, url, source_type, CASE mod WHEN '2019-07-01' THEN '2019-07-01T00:00:00Z' ELSE mod END AS lastmod FROM en)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    site = F.when(i % 5 == 0, "other.example").when(i % 5 == 1, "sub.site.example").otherwise("site.example")
    mod = F.when(i % 3 == 0, "<lastmod>2019-07-01</lastmod>").when(i % 3 == 1, "<lastmod>2020-02-03T04:05:06Z</lastmod>").otherwise("")
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://'), site, pick(_SPOTS), F.lit("</loc>"), mod, F.lit("</url><url><loc></loc></url></urlset>"))
    maps = table(spark, sf_dir, "pages").select("page_id", pick(_TYPES).alias("source_type"), xml.alias("xml"))
    return W.sitemap_entries(maps)


@query("sitemap_entries", f"WITH {ENTRIES} SELECT page_id, source_type, url, lastmod FROM ent")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)


_TARGETS = "CASE " + " ".join(f"WHEN {has('lower(source_type)', words)} THEN {list(wanted)!r}" for words, wanted in W.TARGETS) + f" ELSE {list(W.USUAL_TARGETS)!r} END"


@query("sitemap_scores", f"""WITH {ENTRIES}, a AS (SELECT *, lower(url) AS low, coalesce(CASE WHEN regexp_matches(url, '/2020/03/05/') THEN '2020-03-05T23:59:59Z' END, CASE WHEN regexp_matches(url, '20[0-2][0-9]') THEN regexp_extract(url, '20[0-2][0-9]') || '-12-31T23:59:59Z' END, lastmod) AS avail FROM ent),
b AS (SELECT *, coalesce(TRY_CAST(avail[1:4] AS INT) BETWEEN 2010 AND 2026, FALSE) AS safe, regexp_matches(low, '(?i)\\.pdf($|[?#])') AS pdf, len(list_filter({_TARGETS}, lambda w: contains(low, w))) AS words, len(list_filter(['investor', 'reports'], lambda w: contains(low, w))) AS own FROM a)
SELECT page_id, url, avail AS available_at, CAST(words * 5 + own * 2 + CASE WHEN pdf THEN 4 ELSE 0 END + CASE WHEN safe THEN 3 ELSE 0 END AS INT) AS score FROM b WHERE page_id % 5 <> 0 AND (safe OR regexp_matches(low, '20[0-2][0-9]')) AND (words > 0 OR own > 0 OR pdf)""")
def sitemap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).withColumn("source_url", F.lit("https://site.example/investor/x/reports"))
    return W.sitemap_score(rows, 2010, 2026).select("page_id", "url", "available_at", F.col("score").cast("int").alias("score"))


@query("pdf_scores", f"""WITH p AS (SELECT page_id, 'https://site.example/f' || page_id || CASE page_id % 4 WHEN 0 THEN '_2019.pdf' WHEN 1 THEN '.pdf?v=2' WHEN 2 THEN '.html' ELSE '/2020/03/05/q1.PDF' END AS url, CASE page_id % 3 WHEN 0 THEN 'Earnings transcript, May 9, 2014' WHEN 1 THEN 'media release' ELSE '' END AS context, CASE WHEN page_id % 6 = 0 THEN '2018-01-02T00:00:00Z' END AS page_date, {list(_TYPES)!r}[page_id % 5 + 1] AS source_type FROM pages),
a AS (SELECT *, lower(url || ' ' || context) AS said, coalesce(CASE WHEN page_id % 4 = 3 THEN '2020-03-05T23:59:59Z' END, CASE WHEN page_id % 3 = 0 THEN '2014-05-09T23:59:59Z' END, CASE WHEN regexp_matches(url, '20[0-2][0-9]') THEN regexp_extract(url, '20[0-2][0-9]') || '-12-31T23:59:59Z' END, '') AS own FROM p),
b AS (SELECT *, CASE WHEN coalesce(TRY_CAST(own[1:4] AS INT) BETWEEN 2010 AND 2026, FALSE) THEN 8 ELSE 0 END + 2 * len(list_filter({_TARGETS}, lambda w: contains(said, w))) + CASE WHEN {has('said', W.REPORT_WORDS)} THEN 4 ELSE 0 END AS score FROM a)
SELECT page_id, coalesce(page_date, own) AS available_at, CAST(score AS INT) AS score FROM b WHERE regexp_matches(url, '(?i)\\.pdf($|[?#])') AND (regexp_matches(said, '20[0-2][0-9]') OR own <> '') AND score > 0""")
def pdf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    tail = F.when(i % 4 == 0, "_2019.pdf").when(i % 4 == 1, ".pdf?v=2").when(i % 4 == 2, ".html").otherwise("/2020/03/05/q1.PDF")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("https://site.example/f"), i.cast("string"), tail).alias("url"), F.when(i % 3 == 0, "Earnings transcript, May 9, 2014").when(i % 3 == 1, "media release").otherwise("").alias("context"), F.when(i % 6 == 0, "2018-01-02T00:00:00Z").alias("page_date"),
        F.element_at(F.array(*map(F.lit, _TYPES)), (i % 5 + 1).cast("int")).alias("source_type"),
    )
    return W.pdf_score(rows, 2010, 2026).select("page_id", "available_at", F.col("score").cast("int").alias("score"))


@query("wordpress_posts", "SELECT page_id, 'press room' AS source_type, url || '/p' AS url, 'Press note ' || page_id AS title, 'All of it' AS body, '2021-01-02T03:04:05Z' AS published_at FROM pages WHERE page_id % 4 <> 1")
def wordpress_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    post = F.struct(F.when(F.col("page_id") % 4 != 1, F.concat("url", F.lit("/p"))).otherwise("").alias("link"), F.lit("2021-01-02T03:04:05").alias("date_gmt"), F.struct(F.concat(F.lit("<b>Press</b> note "), i).alias("rendered")).alias("title"), F.struct(F.lit("<p>All\n of</p> it").alias("rendered")).alias("content"))
    other = F.struct(F.lit("https://x.example/zzz").alias("link"), F.lit("").alias("date_gmt"), F.struct(F.lit("nothing").alias("rendered")).alias("title"), F.struct(F.lit("at all").alias("rendered")).alias("content"))
    return W.posts(table(spark, sf_dir, "pages").select("page_id", F.lit("press room").alias("source_type"), F.to_json(F.array(post, other)).alias("payload")))


@query("page_links", r"""WITH l AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS a FROM pages), h AS (SELECT page_id, base, regexp_extract(a, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM l)
SELECT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href ELSE href END AS url, text, count(*) AS n FROM h WHERE starts_with(href, '/') OR regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') GROUP BY ALL""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base"), F.explode(W.links(F.col("html"))).alias("l")).filter("startswith(l.href, '/') OR l.href RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:'")
    return found.groupBy("page_id", W.absolute(F.col("base"), F.col("l.href")).alias("url"), F.col("l.text").alias("text")).agg(F.count("*").alias("n"))


_HEADS = ("<meta property='article:published_time' content='2019-03-05T14:30:00Z'>", "<meta content=\"5 Mar 2019 14:30:00 +0200\" name=\"pubdate\">", "<time datetime='2020-01-02'>x</time>", "<time class='d'>March 9, 2021</time>", "", "<meta name='date' content='soon'>")
_WHEN = ("2019-03-05T14:30:00Z", "2019-03-05T12:30:00Z", "2020-01-02T00:00:00Z", "2021-03-09T23:59:59Z")
_WHY = ("meta", "meta", "time_tag", "time_tag_date_only")


@query("page_published", f"""WITH p AS (SELECT page_id, {list(_WHEN)!r}[page_id % 6 + 1] AS w, {list(_WHY)!r}[page_id % 6 + 1] AS y, CASE WHEN page_id % 5 = 0 THEN '2018-02-03T23:59:59Z' END AS u, CASE WHEN page_id % 7 = 0 THEN '2017-06-05T23:59:59Z' END AS b, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)
SELECT page_id, coalesce(w, u, b, '') AS published_at, CASE WHEN w IS NOT NULL THEN y WHEN u IS NOT NULL THEN 'url_date' WHEN b IS NOT NULL THEN 'body_date' ELSE 'missing' END AS published_by, substr(CASE WHEN trim(regexp_replace(t, '\\s+', ' ', 'g')) <> '' THEN trim(regexp_replace(t, '\\s+', ' ', 'g')) ELSE 'Other title' END, 1, 300) AS title FROM p""")
def page_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (i % 6 + 1).cast("int"))
    html = F.concat(head, F.regexp_replace("html", r"(?is)<meta\b[^>]*>", ""), F.lit("<meta property=\"og:title\" content=\"Other  title\">"))
    url = F.concat(F.lit("https://x.example"), F.when(i % 5 == 0, "/2018/02/03/a").otherwise("/a"))
    at, why = W.published(html, url, F.when(i % 7 == 0, "Berlin, June 5, 2017 - text").otherwise("text"))
    return table(spark, sf_dir, "pages").select("page_id", at.alias("published_at"), why.alias("published_by"), W.page_title(html).alias("title"))


@query("decoded_bodies", "SELECT page_id, 'Café über señor ' || page_id AS text FROM pages")
def decoded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    said = F.concat(F.lit("Café über señor "), i.cast("string"))
    raw = F.when(i % 3 == 0, F.encode(said, "ISO-8859-1")).otherwise(F.encode(said, "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", W.decoded(raw, F.when(i % 3 == 2, "utf-8").otherwise("ISO-8859-1")).alias("text"))


@query("site_counts", f"SELECT {_HOST} AS site, count(*) AS posts FROM pages GROUP BY 1")
def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.site_counts(table(spark, sf_dir, "pages"))


_HOLD = {"JPM": 0.6, "T5": 0.5, "T7": 0.2}
_EVENT = "least(1.0, len(list_filter(list_distinct([lower(event_tags), lower(risk_terms)]), lambda t: regexp_matches(t, '{0}'))) / 4.0::DOUBLE)".format("|".join(G.VIBE_EVENTS))


@query("vibe_scores", f"""WITH {POOL}, a AS (SELECT doc_id, lower(coalesce(source_type, '')) AS k, {_EVENT} AS e, list_filter(tickers, lambda t: t IN ('JPM', 'T5', 'T7')) AS d, doc_id % 11 / 11.0::DOUBLE AS s, doc_id % 5 / 5.0::DOUBLE AS u, doc_id % 7 / 7.0::DOUBLE AS r FROM pool),
b AS (SELECT *, CASE WHEN k IN ('sec_filing_exhibit', 'company_earnings_release') THEN least(1.0, e + 0.35) WHEN k IN ('sec_filing_section', 'company_press_release', 'company_financial_report') THEN least(1.0, e + 0.15) ELSE e END AS ev, least(1.0, coalesce(list_sum(list_transform(d, lambda t: CASE t WHEN 'JPM' THEN 0.6 WHEN 'T5' THEN 0.5 ELSE 0.2 END)), 0))::DOUBLE AS held FROM a)
SELECT doc_id, round(3.0 * held + 1.5 * (len(d) > 0)::INT + 0.45 + 0.75 * ev + 0.35 / 6.0::DOUBLE + 0.2 * 0.9::DOUBLE + 1.2 * s + 0.35 * greatest(u, r) + 2.0 * 0.05::DOUBLE, 6) AS vibe FROM b""")
def vibe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    score = G.vibe(_HOLD, F.col("tickers"), F.array("event_tags"), F.array("risk_terms"), F.col("source_type"), F.lit(0.9), F.lit(0.45), i % 11 / 11.0, i % 5 / 5.0, i % 7 / 7.0, F.lit(0.05))
    return pool(spark, sf_dir).select("doc_id", score.alias("vibe"))


@query("result_rows", f"""WITH {POOL}, a AS (SELECT *, doc_id % 11 / 10.0::DOUBLE AS s, doc_id % 7 / 4.0::DOUBLE AS r, doc_id % 5 / 4.0::DOUBLE AS u, list_filter(tickers, lambda t: t <> 'MARKET') AS tags, lower(coalesce(source_type, '')) AS k, trim(excerpt) AS flat FROM pool)
SELECT doc_id, coalesce(title, '') AS title, CASE WHEN starts_with(k, 'official_macro') THEN 'macro words' WHEN s > 0 THEN 'Signal ' || printf('%.2f', s) || '. Risk ' || printf('%.2f', r) || '. Upside ' || printf('%.2f', u) || '. ' || CASE WHEN len(tags) > 0 THEN array_to_string(tags[1:2], ', ') ELSE replace(coalesce(source_type, 'evidence'), '_', ' ') END || ' evidence available 2020-01-0' || (doc_id % 9 + 1) || '.'
  WHEN length(flat) <= 220 THEN flat ELSE rtrim(substr(flat, 1, 217)) || '...' END AS excerpt, s AS signal_strength FROM a""")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    s, r, u = i % 11 / 10.0, i % 7 / 4.0, i % 5 / 4.0
    at = F.concat(F.lit("2020-01-0"), (i % 9 + 1).cast("string"), F.lit("T00:00:00Z"))
    said = G.result_excerpt(F.col("source_type"), F.col("excerpt"), S.compact_tags(F.col("tickers"), none, none, 2), at, s, r, u, F.lit("macro words"))
    return pool(spark, sf_dir).select("doc_id", F.coalesce("title", F.lit("")).alias("title"), said.alias("excerpt"), s.alias("signal_strength"))


@query("site_records", f"WITH {BASE}, c AS (SELECT d.doc_id, available_at, credibility, round(coalesce(signal, 0) + 0.35 * coalesce(upside, 0) + 0.35 * coalesce(risk, 0), 9) AS order_score, count(*) OVER () AS total FROM docs d LEFT JOIN feats USING (doc_id) WHERE doc_id % 3 <> 2) SELECT doc_id, order_score, total, row_number() OVER (ORDER BY order_score DESC, available_at DESC, credibility DESC, doc_id) AS rank FROM c QUALIFY rank <= 30")
def site_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 3
    docs = _docs(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), F.when(i == 0, "www.site.example").when(i == 1, "ir.site.example").otherwise("othersite.example"), F.lit("/x")))
    return G.site_records(docs, _features(spark, sf_dir), "site.example", 30).select("doc_id", "order_score", "total", "rank")


@query("document_lookup", "WITH k AS (SELECT sha256(coalesce(text, '')) AS key, 'hash' AS kind FROM documents WHERE doc_id % 20 = 0 UNION SELECT 'https://x.example/' || doc_id % 40, 'url' FROM documents WHERE doc_id % 30 = 0 UNION SELECT 'nowhere', 'url'), n AS (SELECT sha256(coalesce(text, '')) AS key, 'hash' AS kind, doc_id FROM documents UNION ALL SELECT 'https://x.example/' || doc_id % 37, 'url', doc_id FROM documents), f AS (SELECT key, kind, min(doc_id) AS doc_id FROM n GROUP BY ALL) SELECT k.key, k.kind, doc_id FROM k LEFT JOIN f USING (key, kind)")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    hashed = F.sha2(F.coalesce("text", F.lit("")), 256)
    at = lambda n: F.concat(F.lit("https://x.example/"), (F.col("doc_id") % n).cast("string"))
    keys = d.filter("doc_id % 20 = 0").select(hashed.alias("key"), F.lit("hash").alias("kind")).union(d.filter("doc_id % 30 = 0").select(at(40), F.lit("url"))).union(spark.createDataFrame([("nowhere", "url")], "key string, kind string")).distinct()
    return G.lookup(d.withColumn("url", at(37)), keys, hashed).select("key", "kind", "doc_id")


@query("folder_decisions", f"WITH {POOL}, g AS (SELECT doc_id % 45 AS query_id, count(DISTINCT folder_key) AS groups FROM pool GROUP BY 1) SELECT query_id, groups, groups >= 3 AND query_id % 2 = 0 AS folders FROM g")
def folder_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = pool(spark, sf_dir).select((F.col("doc_id") % 45).alias("query_id"), F.col("folder_key").alias("group_key"))
    return G.folder_decision(groups, groups.select("query_id").filter("query_id % 2 = 0"))


@query("eval_seed_rows", f"""WITH {POOL}, c AS (SELECT doc_id AS context_id, coalesce(source_type, 'missing') AS source_type, doc_id % 60 AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'test' END AS split, coalesce(intent, '') AS intent, doc_id % 17 / 17.0 AS final_score, doc_id % 13 AS age_days FROM pool),
o AS (SELECT *, row_number() OVER (PARTITION BY source_type, doc_id ORDER BY split DESC, intent DESC, final_score DESC, age_days, context_id) AS own FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY split DESC, intent DESC, final_score DESC, age_days, context_id) AS place FROM o WHERE own = 1)
SELECT 'source_quality:' || source_type || ':' || lpad(CAST(place AS VARCHAR), 3, '0') AS eval_id, context_id, doc_id, CASE WHEN context_id % 2 = 0 THEN context_id % 9 END AS risk FROM p WHERE place <= 4""")
def eval_seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = pool(spark, sf_dir).select(i.alias("context_id"), F.coalesce("source_type", F.lit("missing")).alias("source_type"), (i % 60).alias("doc_id"), F.when(i % 3 == 0, "train").otherwise("test").alias("split"), F.coalesce("intent", F.lit("")).alias("intent"), (i % 17 / 17.0).alias("final_score"), (i % 13).alias("age_days"))
    features = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(i.alias("context_id"), (i % 9).alias("risk"))
    return A.eval_seed(rows, features, 4).select("eval_id", "context_id", "doc_id", "risk")


@query("adjudication_rows", f"""WITH {CORPUS}, c AS (SELECT doc_id AS teacher_id, source AS stratum, round(doc_id * 37 % 101 / 101.0::DOUBLE, 6) AS score FROM corpus), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY score DESC, teacher_id) AS own FROM c), r AS (SELECT *, row_number() OVER (ORDER BY own > 2, CASE WHEN own <= 2 THEN stratum END NULLS FIRST, score DESC, teacher_id) AS rank FROM o)
SELECT teacher_id, stratum, score, rank, CASE WHEN teacher_id % 2 = 0 THEN teacher_id * 2 END AS seed, CASE WHEN teacher_id % 3 = 0 THEN 'p' || teacher_id END AS prediction FROM r WHERE rank <= 90""")
def adjudication_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = corpus(spark, sf_dir)
    compared = d.select(i.alias("teacher_id"), F.col("source").alias("stratum"), F.round(i * 37 % 101 / 101.0, 6).alias("score"))
    seeds = d.filter("doc_id % 2 = 0").select(i.alias("teacher_id"), (i * 2).alias("seed"))
    predictions = d.filter("doc_id % 3 = 0").select(i.alias("teacher_id"), F.concat(F.lit("p"), i.cast("string")).alias("prediction"))
    return A.adjudication(compared, seeds, predictions, "score", "stratum", 90, 2)


@query("informative_series", f"WITH {PANEL}, p AS (SELECT tic AS series, CASE WHEN day_no % 2 = 0 THEN 'text' ELSE 'structured' END AS kind, CASE WHEN tic = 'T3' THEN 0 WHEN tic < 'T2' AND day_no % 60 > 0 THEN 0 WHEN day_no % 11 = 0 THEN NULL ELSE value END AS value FROM panel), s AS (SELECT series, kind, count(*) AS points, round(avg((coalesce(value, 0) = 0)::INT), 6) AS zero_share FROM p GROUP BY ALL) SELECT * FROM s WHERE zero_share < 1 AND (kind <> 'text' OR zero_share < 0.985)")
def informative_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = F.col("tic"), F.col("day_no")
    value = F.when(t == "T3", 0).when((t < "T2") & (d % 60 > 0), 0).when(d % 11 == 0, None).otherwise(F.col("value"))
    return A.informative_series(panel(spark, sf_dir).select(t.alias("series"), F.when(d % 2 == 0, "text").otherwise("structured").alias("kind"), value.cast("double").alias("value")))


@query("scaled_units", "SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN ln(1 + greatest(value - 50, 0)) WHEN event_id % 3 = 1 THEN ln(1 + greatest(value - 50, 0)) ELSE value - 50 END, 8) AS scaled FROM events")
def scaled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("event_id") % 3 == 0, "docs").when(F.col("event_id") % 3 == 1, "terms").otherwise("USD")
    return table(spark, sf_dir, "events").select("event_id", F.round(A.scaled(F.col("value") - 50, unit), 8).alias("scaled"))
