"""Rules that label, grade and route rows: reviewers' exports, source families, chart tones, candidates of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def export_labels(pool: DataFrame, fallback: bool = False) -> tuple[DataFrame, DataFrame]:
    """Judgments from a labelled pool, and the rows that give none with the reason.

    label is text; with `fallback` an empty label takes existing. The first valid row of a (query, document) holds.
    """
    said = F.nullif(F.trim(F.coalesce("label", F.lit(""))), F.lit(""))
    value = F.coalesce(said, F.col("existing").cast("string")) if fallback else said
    again = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("line"))
    rows = pool.withColumns({"value": value, "again": again})
    issue = F.when(F.col("value").isNull(), "missing").when(~F.col("value").isin("0", "1", "2", "3"), "invalid").when(F.col("again") > 1, "duplicate")
    rows = rows.withColumn("issue", issue)
    good = rows.filter("issue IS NULL").select("query_id", "doc_id", F.col("value").cast("int").alias("relevance"))
    return good, rows.filter("issue IS NOT NULL").select("query_id", "doc_id", "line", "issue")


def change_tone(facing: Column, change: Column, dead: float = 0.06) -> Column:
    """Tone of a change: neutral within the dead band; a warning where it goes the bad way; a fall of what faces neither way is neutral."""
    up = change > 0
    return F.when(F.abs(change) < dead, "neutral").when(facing == "high_bad", F.when(up, "warning").otherwise("positive")).when(facing == "low_bad", F.when(up, "positive").otherwise("warning")).otherwise(F.when(up, "positive").otherwise("neutral"))


def return_direction(value: Column, threshold: float) -> Column:
    return F.when(value.isNull(), "missing").when(value >= threshold, "positive").when(value <= -threshold, "negative").otherwise("neutral")


def direction_match(predicted: Column, realised: Column) -> Column:
    """mixed goes with any move; without a realised move nothing is known."""
    return F.when(realised == "missing", None).when(predicted == "mixed", realised != "neutral").otherwise(predicted == realised)


def event_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows, share of directions met, mean and mean size of abnormal returns, by groups."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("match").cast("int")), 6).alias("accuracy"), F.round(F.avg("abnormal"), 8).alias("mean_abnormal"), F.round(F.avg(F.abs("abnormal")), 8).alias("mean_size"))


def provenance(fields: list[str]) -> Column:
    """Share of fields that aren't empty."""
    full = [(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "").cast("int") for f in fields]
    return sum(full[1:], full[0]) / len(fields)


def link_score(url: Column, anchor: Column, terms: list[str]) -> Column:
    """Points of a link on a source page: 12 for a PDF, 8 for a date, 2 a term, less 6 for a bare year."""
    u, both = F.lower(url), F.lower(F.concat_ws(" ", url, anchor))
    out = F.when(u.rlike(r"\.pdf($|\?)"), 12).otherwise(0) + F.when(u.rlike(r"(19|20)\d{2}[/-]?\d{2}"), 8).otherwise(0) - F.when(u.rlike(r"/(19|20)\d{2}/?$"), 6).otherwise(0)
    for t in terms:
        out = out + F.when(both.contains(t), 2).otherwise(0)
    return out


def reject_reason(rows: DataFrame, first: int, last: int, least_words: int = 120) -> Column:
    """The first test that a fetched page fails, null if none."""
    return (
        F.when(~F.coalesce(F.col("status").between(200, 399), F.lit(False)), "bad_status").when(F.lower("content_type").contains("pdf"), "pdf")
        .when(~F.coalesce(F.lower("content_type").contains("html"), F.lit(False)), "not_html").when(F.col("published").isNull(), "no_date")
        .when(~F.year("published").between(first, last), "out_of_range").when(F.col("words") < least_words, "too_short")
    )


def year_pages(sources: DataFrame, first: int, last: int, patterns: list[str]) -> DataFrame:
    """Archive addresses of a source: every pattern for every year."""
    years = F.sequence(F.lit(first), F.lit(last))
    rows = sources.withColumn("year", F.explode(years)).withColumn("pattern", F.explode(F.array(*map(F.lit, patterns))))
    return rows.select("source", "year", F.concat("base_url", F.replace(F.col("pattern"), F.lit("{year}"), F.col("year").cast("string"))).alias("url"))


def overlapping(blocks: DataFrame, first: Column, last: Column) -> DataFrame:
    """Blocks whose days meet a range, both ends included."""
    return blocks.filter((F.col("from_day") <= last) & (F.col("to_day") >= first))


def typeahead(queries: DataFrame, typed: str, n: int = 6) -> DataFrame:
    """The n best stored queries that hold what was typed: at the start 2 points, anywhere 1."""
    q = F.lower("query")
    score = F.when(q.startswith(typed.lower()), 2).when(q.contains(typed.lower()), 1).otherwise(0)
    return queries.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "query").limit(n)


def relevance_of(text: Column, tickers: Column, weights: Column) -> Column:
    """My-feed relevance: holdings named as whole words, by their weights, 1 at most."""
    hit = F.filter(F.map_keys(weights), lambda t: F.array_contains(tickers, t) | F.regexp_like(text, F.concat(F.lit(r"(^|[^A-Za-z0-9])"), t, F.lit(r"([^A-Za-z0-9]|$)"))))
    return F.least(F.lit(1.0), F.aggregate(hit, F.lit(0.0), lambda s, t: s + F.abs(F.try_element_at(weights, t))))


def health(status: Column) -> Column:
    return F.when(status.between(200, 399), "ok").otherwise("failed")
