"""What feeds, sitemaps, posts and pages hold, once fetched: items, links, titles, dates, and how promising a link is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import crawl
from tidemark.operators.linking import host
from tidemark.operators.search import has_any

#: Words that a source of a kind is looked through for; the first kind whose words stand in its type.
TARGETS = (
    (("earnings", "quarter"), ("earnings", "quarter", "quarterly", "financial-results", "financial_results", "results", "q1", "q2", "q3", "q4")),
    (("press", "news"), ("press", "release", "news", "newsroom", "media", "announces")),
    (("presentation", "event"), ("presentation", "presentations", "events", "webcast", "investor-day", "conference")),
    (("report", "annual"), ("annual", "report", "reports", "proxy", "financial", "shareholder")),
)
USUAL_TARGETS = ("investor", "news", "financial", "report", "earnings", "press")
REPORT_WORDS = ("earnings", "annual", "report", "results", "presentation", "transcript")
#: Marks of text that was read in the wrong encoding.
MOJIBAKE = ("Ã", "â", "�", "вЂ", "Р", "С")
#: Where a page's head gives its date, in order.
DATE_METAS = (("property", "article:published_time"), ("property", "og:published_time"), ("name", "date"), ("name", "Date"), ("name", "dc.date"), ("name", "DC.date"), ("name", "pubdate"), ("itemprop", "datePublished"))
TITLE_METAS = (("property", "og:title"), ("name", "twitter:title"), ("name", "title"))
PDF = r"(?i)\.pdf(?:$|[?#])"
RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string>>>"
SITEMAP = "url array<struct<loc: string, lastmod: string>>"
POSTS = "array<struct<link: string, date_gmt: string, title: struct<rendered: string>, content: struct<rendered: string>>>"


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A row for each item of each feed; a feed that isn't XML has none."""
    items = feeds.withColumn("feed_", F.from_xml(F.col(xml), RSS, {"mode": "PERMISSIVE"})).withColumn("item", F.explode("feed_.channel.item"))
    kept = [c for c in feeds.columns if c != xml]
    return items.select(*kept, clean(F.col("item.title")).alias("title"), clean(F.col("item.link")).alias("url"), crawl.utc_text(F.col("item.pubDate")).alias("published_at"), clean(F.col("item.description")).alias("summary"))


def sitemap_entries(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """A row for each address of each sitemap, with its last change."""
    rows = maps.withColumn("map_", F.from_xml(F.col(xml), SITEMAP, {"mode": "PERMISSIVE"})).withColumn("entry", F.explode("map_.url"))
    kept = [c for c in maps.columns if c != xml]
    changed = crawl.utc_text(F.col("entry.lastmod"))
    day = F.regexp_extract(F.coalesce("entry.lastmod", F.lit("")), r"^(20[0-2][0-9]-\d{2}-\d{2})", 1)
    return rows.select(*kept, clean(F.col("entry.loc")).alias("url"), F.coalesce(changed, F.when(day != "", F.concat(day, F.lit("T23:59:59Z"))), F.lit("")).alias("lastmod")).filter("url <> ''")


def targets(kind: Column) -> Column:
    """The words to look for at a source of a kind."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    out = F.array(*map(F.lit, USUAL_TARGETS))
    for words, wanted in reversed(TARGETS):
        out = F.when(has_any(k, words), F.array(*map(F.lit, wanted))).otherwise(out)
    return out


def hits(text: Column, words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def posts(payloads: DataFrame, payload: str = "payload", kind: str = "source_type") -> DataFrame:
    """A row for each post of a JSON payload that has a link and any of its source's words; markup dropped."""
    bare = lambda c: clean(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))
    rows = payloads.withColumn("post", F.explode(F.from_json(F.col(payload), POSTS)))
    kept = [c for c in payloads.columns if c != payload]
    rows = rows.select(*kept, F.col("post.link").alias("url"), bare(F.col("post.title.rendered")).alias("title"), bare(F.col("post.content.rendered")).alias("body"), crawl.utc_text(F.col("post.date_gmt")).alias("published_at"))
    said = F.lower(F.concat_ws(" ", "url", "title", F.substring("body", 1, 500)))
    return rows.filter((F.coalesce("url", F.lit("")) != "") & (hits(said, targets(F.col(kind))) > 0))


def _in_years(at: Column, first: int, last: int) -> Column:
    return F.coalesce(F.substring(at, 1, 4).try_cast("int").between(first, last), F.lit(False))


def _within(url: Column, source: Column) -> Column:
    """Same host, or one below it."""
    a, b = host(url), host(source)
    return (a == b) | a.endswith(F.concat(F.lit("."), b))


def sitemap_score(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Adds available_at and score to addresses (url, lastmod, source_url, source_type) of the source's site that have a year and a word, a part of the source's path or a PDF."""
    low = F.lower("url")
    path = F.lower(F.regexp_extract("source_url", r"^[A-Za-z]+://[^/]*([^?#]*)", 1))
    parts = F.filter(F.split(path, r"[-_/]+"), lambda w: F.length(w) >= 4)
    at = crawl.candidate_available_at(F.col("url"), F.lit(""), F.col("lastmod"))
    safe, pdf = _in_years(at, first, last), low.rlike(PDF)
    words, own = hits(low, targets(F.col("source_type"))), hits(low, parts)
    good = _within(F.col("url"), F.col("source_url")) & (safe | low.rlike("20[0-2][0-9]")) & ((words > 0) | (own > 0) | pdf)
    score = words * 5 + own * 2 + F.when(pdf, 4).otherwise(0) + F.when(safe, 3).otherwise(0)
    return rows.withColumns({"available_at": at, "score": score}).filter(good)


def pdf_score(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Adds available_at and score to PDF links (url, context, page_date, source_type) that have a year; a page's date stands for its links'."""
    said = F.concat_ws(" ", F.lower("url"), F.lower("context"))
    own = crawl.candidate_available_at(F.col("url"), F.col("context"), F.lit(""))
    words = 2 * hits(said, targets(F.col("source_type")))
    score = F.when(_in_years(own, first, last), 8).otherwise(0) + words + F.when(has_any(said, REPORT_WORDS), 4).otherwise(0)
    good = F.col("url").rlike(PDF) & (said.rlike("20[0-2][0-9]") | (own != "")) & (score > 0)
    return rows.withColumns({"available_at": F.coalesce("page_date", own), "score": score}).filter(good)


def links(html: Column) -> Column:
    """(href, text) of every link of a page, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), clean(F.regexp_replace(x, "(?s)<[^>]+>", " ")).alias("text")))


def absolute(base: Column, href: Column) -> Column:
    """An address as seen from a page: whole, of its scheme, of its site, or beside it."""
    scheme, site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))


def _meta(html: Column, key: str, name: str) -> Column:
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{key}\s*=\s*[\"']{name.replace('.', '[.]')}[\"'][^>]*>", 0)
    return F.nullif(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def page_title(html: Column) -> Column:
    html = F.coalesce(html, F.lit(""))
    own = F.nullif(clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return F.substring(F.coalesce(own, *[clean(_meta(html, k, n)) for k, n in TITLE_METAS], F.lit("")), 1, 300)


def published(html: Column, url: Column, text: Column) -> tuple[Column, Column]:
    """When a page was published and what says so: its head, a time tag, its address, or a date in the first 3,000 characters of its text."""
    html = F.coalesce(html, F.lit(""))
    first = lambda values: F.get(F.filter(F.transform(F.array(*values), crawl.utc_text), lambda x: x.isNotNull()), F.lit(0))
    tag = F.regexp_extract(html, r"(?is)<time\b[^>]*>.*?</time>", 0)
    own = [F.nullif(F.regexp_extract(tag, rf"(?is)^<time\b[^>]*\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")) for a in ("datetime", "content")]
    steps = (
        (first([_meta(html, k, n) for k, n in DATE_METAS]), "meta"), (first(own), "time_tag"), (crawl.end_of_day(crawl.month_date(F.regexp_replace(tag, "(?s)<[^>]+>", " "))), "time_tag_date_only"), (crawl.end_of_day(crawl.path_date(url)), "url_date"),
        (crawl.end_of_day(crawl.month_date(F.substring(text, 1, 3000))), "body_date"), (F.lit(""), "missing"),
    )
    found = F.get(F.filter(F.array(*[F.struct(at.alias("at"), F.lit(why).alias("why")) for at, why in steps]), lambda s: s["at"].isNotNull()), F.lit(0))
    return found["at"], found["why"]


def mojibake(text: Column) -> Column:
    """How many marks of a wrong encoding stand in a text."""
    marks = [(F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m) for m in MOJIBAKE]
    return sum(marks[1:], marks[0]).cast("int")


def decoded(raw: Column, declared: Column) -> Column:
    """Bytes of a response as text: in the declared encoding (UTF-8 or Latin-1), or in UTF-8 where that has fewer marks of a wrong one."""
    utf8, latin = F.make_valid_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1")
    said = F.lower(F.coalesce(declared, F.lit("utf-8")))
    own = F.contains(F.lower(F.substring(latin, 1, 4096)), F.lit("charset=utf-8")) | ~said.isin("iso-8859-1", "latin-1", "latin1")
    return F.when(own | (mojibake(utf8) < mojibake(latin)), utf8).otherwise(latin)


def site_counts(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.groupBy(host(F.col(url)).alias("site")).agg(F.count("*").alias("posts"))
