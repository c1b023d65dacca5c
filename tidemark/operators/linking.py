"""Entities in texts, sources of records, URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")
#: First words of names that are looked up in a list; more are joined.
FEW = 1000


def phrase_words(text: Column) -> Column:
    """Lower-case runs of letters and digits: two phrases match where their words do, whatever stands between."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def link_phrases(docs: DataFrame, names: DataFrame, doc: str = "doc_id", text: str = "body") -> DataFrame:
    """(doc, entity) for each entity one of whose names (entity, name) stands in the text as whole words.

    Texts meet names through a name's first word, an equi-join; only then are the words that follow compared. So no text is
    tried against every name.
    """
    words = names.select("entity", phrase_words(F.col("name")).alias("words")).filter(F.size("words") > 0)
    words = words.select("entity", "words", F.get("words", F.lit(0)).alias("first")).distinct()
    first = words.select("first").distinct()
    own = docs.select(doc, phrase_words(F.col(text)).alias("text_words"))
    own = own.withColumn("followed", F.transform("text_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    longest = words.agg(F.max(F.size("words")).alias("longest"))
    begins = F.col("followed")
    if first.limit(FEW + 1).count() <= FEW:  # places where no name begins go before they are rows
        longest = words.agg(F.max(F.size("words")).alias("longest"), F.collect_set("first").alias("firsts"))
        begins = F.filter("followed", lambda x: F.array_contains("firsts", x["w"]))
    runs = F.transform(begins, lambda x: F.struct(x["w"].alias("first"), F.slice("text_words", x["i"] + 1, F.col("longest")).alias("run")))
    places = own.crossJoin(F.broadcast(longest)).select(doc, F.explode(runs).alias("p"))
    places = places.select(doc, "p.first", "p.run").join(first, "first", "left_semi")
    hits = places.join(words, "first").filter(F.slice("run", F.lit(1), F.size("words")) == F.col("words"))
    return hits.select(doc, "entity").distinct()


def enrich(docs: DataFrame, links: DataFrame, column: str, doc: str = "doc_id") -> DataFrame:
    """column becomes the sorted union of what it held and what was linked."""
    found = links.groupBy(doc).agg(F.collect_set("entity").alias("linked_"))
    both = F.array_sort(F.array_union(F.coalesce(column, F.array().cast("array<string>")), F.coalesce("linked_", F.array().cast("array<string>"))))
    return docs.join(found, doc, "left").withColumn(column, both).drop("linked_")


def host(url: Column) -> Column:
    """Host in lower case, without www. and a port."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default ports, tracking parameters, fragment and a trailing slash gone, parameters sorted."""
    part = lambda i: F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    place = F.regexp_replace(F.lower(part(2)), r":(80|443)$", "")
    path = F.when(part(3) == "", F.lit("/")).otherwise(F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), "/+$", "")).otherwise(part(3)))
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(part(1) == "", F.trim(F.coalesce(url, F.lit("")))).otherwise(F.concat(F.lower(part(1)), F.lit("://"), place, path, query))


def url_date(url: Column) -> Column:
    """A date in a URL: /2020/03/09, /2020-03-09 or 20200309; null if there is none or it isn't one."""
    slashed = F.regexp_extract(url, r"/((?:19|20)\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:\D|$)", 0)
    pick = lambda i: F.regexp_extract(url, r"/((?:19|20)\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:\D|$)", i)
    compact = F.regexp_extract(url, r"(?:^|\D)((?:19|20)\d{6})(?:\D|$)", 1)
    return F.when(slashed != "", F.try_to_date(F.concat_ws("-", pick(1), F.lpad(pick(2), 2, "0"), F.lpad(pick(3), 2, "0")))).otherwise(F.try_to_date(compact, "yyyyMMdd"))


def match_source(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds entry_id and matched_by: the registry entry by id, else by name, else by host or the longest domain above it.

    Domains above a host are spelled out, so a suffix match is an equi-join; the first entry of the registry wins.
    """
    first = lambda key: registry.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min_by("entry_id", "order").alias(f"by_{key}"))
    rows = records.join(registry.select("entry_id").withColumnRenamed("entry_id", "by_id"), F.col("source_id") == F.col("by_id"), "left")
    rows = rows.join(first("name"), F.lower("source_name") == F.lower("name"), "left").drop("name")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = rows.select("record_id", "host").distinct().select("record_id", F.explode(above).alias("domain"))
    own = registry.select(F.col("host").alias("domain"), "entry_id", "order").filter("domain <> ''")
    by_host = spread.join(own, "domain").groupBy("record_id").agg(F.min_by("entry_id", "order").alias("by_host"))
    rows = rows.join(by_host, "record_id", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").when(F.col("by_host").isNotNull(), "host")
    return rows.withColumns({"entry_id": F.coalesce("by_id", "by_name", "by_host"), "matched_by": how}).drop("by_id", "by_name", "by_host")


def search_score(title: Column, text: Column, tickers: Column, terms: list[str]) -> Column:
    """2 for each term in the title, 1 in the text, 2.5 if it is a ticker."""
    out = F.lit(0.0)
    for t in terms:
        out = out + F.when(F.contains(F.lower(title), F.lit(t)), 2.0).otherwise(0.0) + F.when(F.contains(F.lower(text), F.lit(t)), 1.0).otherwise(0.0) + F.when(F.array_contains(F.transform(tickers, F.lower), t), 2.5).otherwise(0.0)
    return out


def prefix_search(posts: DataFrame, terms: list[str], doc: str = "doc_id") -> DataFrame:
    """Documents with words that begin with any of the terms, and how often."""
    test = F.lit(False)
    for t in terms:
        test = test | F.col("term").startswith(t)
    return posts.filter(test).groupBy(doc).agg(F.sum("tf").alias("hits"))


def ranked_overall(rows: DataFrame, score: str, time: str, order: list[Column], slices: int) -> DataFrame:
    """Adds rank over all rows, by score (descending), time (descending), then order, with no task that sees all rows.

    Scores have few values: ranks are counted by score, by slice of time in a score, and by row in a slice.
    """
    span = rows.agg(F.min(time).alias("from_"), F.max(time).alias("to_"))
    minutes = lambda a, b: F.timestamp_diff("MINUTE", a, b)
    place = F.floor(minutes(F.col(time), F.col("to_")) * slices / (minutes(F.col("from_"), F.col("to_")) + 1)).cast("int")
    rows = rows.crossJoin(F.broadcast(span)).withColumn("slice_", place).drop("from_", "to_")
    n = rows.groupBy(score, "slice_").agg(F.count("*").alias("n_"))
    before = lambda by, key: F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = n.groupBy(score).agg(F.sum("n_").alias("n_")).select(score, before([], F.desc(score)).alias("above_"))
    n = n.select(score, "slice_", before([score], F.col("slice_")).alias("newer_")).join(total, score)
    own = F.row_number().over(Window.partitionBy(score, "slice_").orderBy(F.desc(time), *order))
    return rows.join(n, [score, "slice_"]).withColumn("rank", F.col("above_") + F.col("newer_") + own).drop("slice_", "above_", "newer_")


def ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
