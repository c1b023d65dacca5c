"""Queries of entity links, URLs, search and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import linking as L
from tidemark.operators import portfolio as P
from tidemark.operators import retrieval as R
from tidemark.operators import rules
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, corpus, table, tokens_sql

_NAMES = ("the onble", "ation", "der", "de la", "that", "und die", "la", "inin the")
_MATCH = " UNION ALL ".join(f"SELECT doc_id, 'E{i}' AS entity FROM w WHERE contains(w, ' {n} ')" for i, n in enumerate(_NAMES))


@query("entity_link", f"WITH w AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS w FROM documents) {_MATCH}")
def entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(f"E{i}", n) for i, n in enumerate(_NAMES)], "entity string, name string")
    return L.link_phrases(corpus(spark, sf_dir), names)


@query("entity_enrich", f"WITH {CORPUS}, w AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS w FROM documents), l AS ({_MATCH}), g AS (SELECT doc_id, list(entity) AS e FROM l GROUP BY doc_id) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(tickers, coalesce(e, [])))), '|') AS tickers FROM corpus LEFT JOIN g USING (doc_id)")
def entity_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir)
    return L.enrich(d.select("doc_id", "tickers"), entity_link(spark, sf_dir), "tickers").withColumn("tickers", F.array_join("tickers", "|"))


_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
_TRACK = ", ".join(f"'{t}'" for t in L.TRACKING)


@query("url_canonical", rf"""WITH p AS (SELECT page_id, regexp_extract(url, {_URL}, 1) AS s, lower(regexp_extract(url, {_URL}, 2)) AS h, regexp_extract(url, {_URL}, 3) AS path, list_sort(list_filter(string_split(regexp_extract(url, {_URL}, 4), '&'), lambda x: x <> '' AND NOT list_contains([{_TRACK}], split_part(x, '=', 1)))) AS q FROM pages)
SELECT page_id, lower(s) || '://' || regexp_replace(h, ':(80|443)$', '') || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url, regexp_replace(h, '^www\.', '') AS host FROM p""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", L.canonical_url(F.col("url")).alias("url"), L.host(F.col("url")).alias("host"))


@query("url_dates", "SELECT doc_id, CAST(DATE '2010-01-01' + CAST(doc_id % 4000 AS INT) AS VARCHAR) AS day FROM documents")
def url_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2010-01-01").cast("date"), (F.col("doc_id") % 4000).cast("int"))
    forms = F.when(F.col("doc_id") % 3 == 0, F.date_format(day, "/yyyy/M/d/")).when(F.col("doc_id") % 3 == 1, F.date_format(day, "/yyyy-MM-dd-")).otherwise(F.date_format(day, "_yyyyMMdd"))
    return corpus(spark, sf_dir).select("doc_id", L.url_date(F.concat(F.lit("https://x.example/news"), forms)).cast("string").alias("day"))


@query("registry_match", r"""WITH r AS (SELECT page_id AS record_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages), x AS (SELECT *, array_slice(string_split(host, '.'), -3, NULL) AS tail FROM r)
SELECT record_id, CASE WHEN record_id % 10 = 0 THEN 'R1' WHEN record_id % 10 = 1 THEN 'R2' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'R2' WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'R3' END AS entry_id,
 CASE WHEN record_id % 10 = 0 THEN 'id' WHEN record_id % 10 = 1 THEN 'name' WHEN ends_with('.' || host, '.example.org') OR ends_with('.' || host, '.example.net') THEN 'host' END AS matched_by FROM x""")
def registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("R1", "alpha", "other.example", 0), ("R2", "beta", "example.org", 1), ("R3", "gamma", "example.net", 2)], "entry_id string, name string, host string, order int")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), L.host(F.col("url")).alias("host"), F.when(F.col("page_id") % 10 == 0, "R1").alias("source_id"), F.when(F.col("page_id") % 10 == 1, "Beta").alias("source_name"))
    return L.match_source(rows, registry).select("record_id", "entry_id", "matched_by")


_TERMS = ["ation", "ment", "t3", "ung"]
_LEX = " + ".join(f"CASE WHEN contains(lower(substr(body, 1, 60)), '{t}') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(body), '{t}') THEN 1.0 ELSE 0 END + CASE WHEN list_contains(list_transform(tickers, lambda x: lower(x)), '{t}') THEN 2.5 ELSE 0 END" for t in _TERMS)


def _found(d: DataFrame) -> DataFrame:
    """Scored documents of a corpus."""
    lexical = L.search_score(F.substring("body", 1, 60), F.col("body"), F.col("tickers"), _TERMS)
    d = d.select("doc_id", "source", "available_at", lexical.alias("lexical"), rules.entity_alignment(F.col("tickers"), F.array(F.lit("T3")), F.lit("news"), F.lit(False)).alias("entity"), "severity", "credibility")
    return d.withColumn("score", F.round(F.col("lexical") + 1.15 * F.col("severity") + 0.30 * F.col("credibility") + F.col("entity"), 6)).filter("score > 0")


@query("web_search", f"""WITH {CORPUS}, s AS (SELECT doc_id, source, available_at, ({_LEX})::DOUBLE AS lexical, severity, credibility, CASE WHEN list_contains(tickers, 'T3') THEN 6.0 WHEN len(tickers) = 0 THEN -4.0 ELSE -10.0 END::DOUBLE AS entity FROM corpus),
f AS (SELECT *, round(lexical + 1.15 * severity + 0.30 * credibility + entity, 6) AS score FROM s) SELECT doc_id, source, lexical, entity, score, row_number() OVER (ORDER BY score DESC, available_at DESC, doc_id DESC) AS rank FROM f WHERE score > 0""")
def web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched and ranked."""
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return L.ranked_overall(_found(corpus(spark, sf_dir)), "score", "available_at", [F.desc("doc_id")], slices).select("doc_id", "source", "lexical", "entity", "score", "rank")


@query("prefix_search", f"WITH {CORPUS} SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest({tokens_sql('body')}) AS term FROM corpus) WHERE starts_with(term, 'than') OR starts_with(term, 'ciu') GROUP BY doc_id")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.prefix_search(R.postings(corpus(spark, sf_dir)), ["than", "ciu"])


HOLD = "hold AS (SELECT o_custkey AS portfolio_id, l_partkey AS tic, 'S' || (l_partkey % 9) AS sector, l_extendedprice / l_quantity AS price, l_quantity AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey), hv AS (SELECT *, price * quantity AS value, price * quantity / sum(price * quantity) OVER (PARTITION BY portfolio_id) AS weight FROM hold WHERE price > 0 AND quantity > 0)"


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.selectExpr("o_custkey as portfolio_id", "l_partkey as tic", "concat('S', cast(l_partkey % 9 as string)) as sector", "l_extendedprice / l_quantity as price", "l_quantity as quantity")


@query("portfolio_summary", f"""WITH {HOLD}, s AS (SELECT portfolio_id, sector, sum(weight) AS w FROM hv GROUP BY ALL), d AS (SELECT portfolio_id, arg_min(sector, ROW(-round(w, 9), sector)) AS dominant_sector, max(w) AS sector_weight FROM s GROUP BY portfolio_id),
t AS (SELECT portfolio_id, sum(value) AS value, count(*) AS holdings, list_sort(list(weight), 'DESC') AS ws FROM hv GROUP BY portfolio_id), u AS (SELECT *, round(ws[1], 9) AS t1, round(ws[1] + coalesce(ws[2], 0), 9) AS t2 FROM t)
SELECT portfolio_id, round(value, 2) AS value, holdings, t1 AS top1, t2 AS top2, dominant_sector, round(sector_weight, 9) AS sector_weight, CASE WHEN t1 >= 0.3 OR t2 >= 0.5 THEN 'high' WHEN t1 >= 0.2 THEN 'moderate' ELSE 'balanced' END AS concentration FROM u JOIN d USING (portfolio_id)""")
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.summary(_holdings(spark, sf_dir))
    return out.select("portfolio_id", F.round("value", 2).alias("value"), "holdings", *[F.round(c, 9).alias(c) for c in ("top1", "top2")], "dominant_sector", F.round("sector_weight", 9).alias("sector_weight"), "concentration")


@query("sector_slices", f"""WITH {HOLD}, s AS (SELECT portfolio_id, sector, sum(weight) AS w FROM hv GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY round(w, 9) DESC, sector) AS place, count(*) OVER (PARTITION BY portfolio_id) AS n FROM s)
SELECT portfolio_id, CASE WHEN n > 6 AND place > 5 THEN 'Other' ELSE sector END AS slice, round(sum(w), 8) AS weight FROM r GROUP BY ALL""")
def sector_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sector_slices(_holdings(spark, sf_dir)).withColumn("weight", F.round("weight", 8))


@query("regime_vote", f"WITH {CORPUS}, t AS (SELECT doc_id, [sin(doc_id), cos(doc_id), sin(doc_id * 2)] AS s FROM corpus), v AS (SELECT doc_id, list_sum(list_transform(s, lambda x: CASE WHEN x >= 0.35 THEN 1 WHEN x <= -0.35 THEN -1 ELSE 0 END)) AS n FROM t) SELECT doc_id, CASE WHEN n >= 2 THEN 'risk_on' WHEN n <= -2 THEN 'risk_off' ELSE 'transition' END AS regime FROM v")
def regime_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return corpus(spark, sf_dir).select("doc_id", P.regime([P.tone(x) for x in (F.sin(i), F.cos(i), F.sin(i * 2))]).alias("regime"))


@query("signal_strength", f"WITH {CORPUS} SELECT doc_id, round(0.85 * severity + 0.65 * severity + 0.45 * credibility + 0.35 * severity + 0.40 * credibility + 0.30 * severity + 0.25 * credibility + 0.30 * abs(severity - 0.5) + 0.25 * least(1.0, (doc_id % 9) / 6.0), 6) AS strength FROM corpus")
def signal_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.col("severity"), F.col("credibility")
    f = {"relevance": s, "severity": s, "risk": c, "uncertainty": s, "opportunity": c, "forward": s, "final": c, "sentiment": s - 0.5}
    return corpus(spark, sf_dir).select("doc_id", F.round(P.signal_strength(f, F.col("doc_id") % 9), 6).alias("strength"))
