"""Queries of de-duplication, sampling and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import selection as D
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, corpus


@query("dedupe_first_wins", "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 OR text = ''")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).select("doc_id", "source", "n_chars", F.sha2("body", 256).alias("hash"))
    return D.first_wins(d, ["hash"], ["doc_id"]).drop("hash")


@query("dedupe_longest_wins", "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_longest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", F.concat_ws("|", "source", "lang").alias("key"))
    return D.best_wins(d, "key", F.col("n_chars"), ["doc_id"]).drop("key")


@query("content_hash_clusters", r"SELECT sha256(chr(10) || lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS cluster, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.copies(corpus(spark, sf_dir), X.content_hash(F.lit(""), "body"))


@query("document_hashes", "SELECT doc_id, sha256(source || chr(10) || doc_id || chr(10) || lang || chr(10) || text) AS document_hash, substr(sha1(source || '|' || doc_id), 1, 16) AS short_id FROM documents")
def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", X.document_hash(F.col("source"), F.col("doc_id"), F.col("lang"), F.col("body")).alias("document_hash"), X.short_hash(F.col("source"), F.col("doc_id").cast("string")).alias("short_id"))


@query("excerpts", r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substr(t, 1, 117)) || '...' END AS excerpt, len(regexp_extract_all(t, '\S+')) AS words FROM f")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", X.excerpt("body", 120).alias("excerpt"), X.word_count("body").cast("long").alias("words"))


@query("number_parse", "SELECT o_orderkey, o_totalprice AS positive, -o_totalprice AS negative, CAST(NULL AS DOUBLE) AS none FROM orders")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    return o.select("o_orderkey", X.number_of(F.concat(F.lit("$ "), price)).alias("positive"), X.number_of(F.concat(F.lit("("), price, F.lit(")"))).alias("negative"), X.number_of(F.lit("n/a")).alias("none"))


@query("stratified_seed", "SELECT doc_id, source, lang, own FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS own FROM documents) ORDER BY CASE WHEN own > 1 THEN 1 ELSE 0 END, doc_id LIMIT 120")
def stratified_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stratified(corpus(spark, sf_dir).select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], 120)


@query("eval_seed", "SELECT doc_id, source, own FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS own FROM documents) WHERE own <= 3")
def eval_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.per_group(corpus(spark, sf_dir), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("doc_id", "source", "own")


@query("evenly_spaced", "WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS size FROM documents) SELECT doc_id, lang, slot FROM n WHERE size <= 12 OR list_contains(list_transform(range(12), lambda i: CAST(round_even(i * (size - 1) / 11.0, 0) AS BIGINT)), slot)")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.evenly_spaced(corpus(spark, sf_dir).select("doc_id", "lang"), ["lang"], ["doc_id"], 12)


@query("quota_sample", """WITH k AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS kind FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY doc_id) <= CASE kind WHEN '10-K' THEN 2 WHEN '10-Q' THEN 4 ELSE 3 END AS within FROM k)
SELECT doc_id, source, within, own FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY within DESC, doc_id) AS own FROM w) WHERE own <= 9""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of 22% and 45% of nine, the rest for other forms."""
    kind = F.when(F.col("doc_id") % 4 == 0, "10-K").when(F.col("doc_id") % 4 == 1, "10-Q").otherwise("8-K")
    return D.quotas(corpus(spark, sf_dir).select("doc_id", "source"), ["source"], kind, {"10-K": 2, "10-Q": 4}, ["doc_id"], 9)


@query("group_leaders", f"""WITH {CORPUS}, r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY severity DESC, doc_id DESC) AS place FROM corpus)
SELECT source, min_by(doc_id, place) AS leader, coalesce(string_agg(doc_id, '|' ORDER BY place) FILTER (WHERE place BETWEEN 2 AND 6), '') AS children, count(*) AS n, max(place) > 6 AS has_more FROM r GROUP BY source""")
def group_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.leaders(corpus(spark, sf_dir).select("source", "doc_id", "severity"), "source", [F.desc("severity"), F.desc("doc_id")])


@query("folder_rollup", f"WITH {CORPUS} SELECT source, strftime(available_at, '%Y-%m') AS month, max(available_at) AS newest, count(*) AS docs, round(avg(severity), 6) AS mean_severity, count_if(severity >= 0.5) AS severe FROM corpus GROUP BY ALL")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).groupBy("source", F.date_format("available_at", "yyyy-MM").alias("month"))
    return rows.agg(F.max("available_at").alias("newest"), F.count("*").alias("docs"), F.round(F.avg("severity"), 6).alias("mean_severity"), F.count_if(F.col("severity") >= 0.5).alias("severe"))


@query("fresh_first_rank", f"WITH {CORPUS} SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY available_at DESC, severity DESC, doc_id DESC) AS rank FROM corpus")
def fresh_first_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("available_at"), F.desc("severity"), F.desc("doc_id"))
    return corpus(spark, sf_dir).select("doc_id", F.row_number().over(w).alias("rank"))


@query("result_page", f"WITH {CORPUS} SELECT doc_id, severity, row_number() OVER (ORDER BY severity DESC, available_at DESC, doc_id DESC) AS place FROM corpus QUALIFY place BETWEEN 26 AND 50")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page(corpus(spark, sf_dir).select("doc_id", "severity", "available_at"), [F.desc("severity"), F.desc("available_at"), F.desc("doc_id")], 25, 40).drop("available_at")


@query("favourite_promotion", f"""WITH {CORPUS}, r AS (SELECT doc_id, lang, source AS site, source IN ('src1', 'src4') AS fav, severity, max(severity) OVER (PARTITION BY lang) AS most FROM corpus)
SELECT doc_id, fav AND max(CASE WHEN fav AND severity >= CASE WHEN most > 0.5 THEN 0.6 * most ELSE -1 END THEN 1 ELSE 0 END) OVER (PARTITION BY lang, site) = 1 AS promoted FROM r""")
def favourite_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("doc_id", "lang", F.col("source").alias("site"), "severity")
    return D.promote(rows, F.col("site").isin("src1", "src4"), "severity", ["lang"]).select("doc_id", "promoted")


@query("combine_by_key", "SELECT doc_id, part FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS rn FROM (SELECT doc_id, 0 AS part FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 3 = 0)) WHERE rn = 1")
def combine_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).select("doc_id")
    both = d.filter("doc_id % 2 = 0").withColumn("part", F.lit(0)).unionByName(d.filter("doc_id % 3 = 0").withColumn("part", F.lit(1)))
    return D.first_wins(both, ["doc_id"], ["part"])


@query("append_new_only", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def append_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_anti")
