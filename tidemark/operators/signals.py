"""Signals of documents by portfolio and ticker, what features proved useful, feeds, favourites and projections for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.linking import host

#: Prefixes of a feature's name that its aliases leave out.
PLAIN_PREFIXES = ("stock_text_avg_", "portfolio_text_avg_")
SIGNAL_PREFIXES = ("stock_signal_", "portfolio_signal_")
#: Words that add to a post's relevance.
EVENT_TERMS = ("earnings", "guidance", "rates", "inflation", "credit", "lawsuit", "regulation", "margin", "demand")


def best(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their rank; n is the list's size."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def relevant(docs: DataFrame, features: DataFrame, holdings: DataFrame) -> DataFrame:
    """Documents with features that name a holding (ticker) or the market; matched holds the holdings."""
    named = docs.select("doc_id", F.explode("tickers").alias("ticker"))
    mine = named.join(holdings.select("ticker").distinct(), "ticker").groupBy("doc_id").agg(F.array_sort(F.collect_set("ticker")).alias("matched"))
    rows = docs.join(features, "doc_id").join(mine, "doc_id", "left")
    rows = rows.withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
    return rows.filter((F.size("matched") > 0) | F.array_contains("tickers", "MARKET"))


def ticker_signals(rows: DataFrame, n: int = 10) -> DataFrame:
    """Mean signal, risk and upside of each holding's documents; the n strongest."""
    by = rows.select(F.explode("matched").alias("ticker"), "signal", "risk", "upside").groupBy("ticker")
    out = by.agg(F.count("*").alias("docs"), *[F.round(F.avg(c), 6).alias(c) for c in ("signal", "risk", "upside")])
    return best(out, [F.desc("signal"), F.desc("upside"), F.asc("risk"), F.asc("ticker")], n)


def strongest(rows: DataFrame, score: str, n: int = 5) -> DataFrame:
    """The n documents with the highest positive score, newest first among equals."""
    return best(rows.filter(F.col(score) > 0).withColumn("score", F.round(score, 6)), [F.desc("score"), F.desc("available_at"), F.asc("doc_id")], n)


def usefulness(relations: DataFrame) -> DataFrame:
    """(alias, score): the largest score of any feature (feature, three scores) of that name or alias."""
    name = F.col("feature")
    aliases = [name]
    aliases += [F.when(name.startswith(p), F.substring(name, F.lit(len(p) + 1), F.length(name))) for p in PLAIN_PREFIXES]
    aliases += [F.when(name.startswith(p), F.concat(F.lit("signal_"), F.regexp_replace(F.regexp_replace(F.substring(name, F.lit(len(p) + 1), F.length(name)), "_count$", ""), "_flag$", ""))) for p in SIGNAL_PREFIXES]
    score = F.greatest(*[F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in ("train_only_screen_score", "best_abs_train_spearman", "best_abs_test_spearman")])
    rows = relations.filter(F.coalesce(name, F.lit("")) != "").select(F.explode(F.array_compact(F.array(*aliases))).alias("alias"), score.alias("score"))
    return rows.groupBy("alias").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def signal_candidates(docs: DataFrame, features: DataFrame, mode: str, cutoff: Column, n: int) -> DataFrame:
    """Documents with a signal by the cutoff, by what the mode looks for, then the newest; n is the list's size."""
    order = {"opportunity": F.col("upside") + F.col("signal"), "risk": F.col("risk") + F.col("signal")}.get(mode, F.col("signal"))
    rows = docs.join(features.filter("signal > 0"), "doc_id").filter(F.col("available_at") <= cutoff).withColumn("order_score", F.round(order, 9))
    return best(rows, [F.desc("order_score"), F.desc("available_at"), F.asc("doc_id")], n)


def ticker_candidates(docs: DataFrame, features: DataFrame, tickers: list[str], cutoff: Column, n: int) -> DataFrame:
    """Documents of any of the tickers, newest first, then by their signals and credibility, with how many there are in all."""
    found = docs.filter(F.arrays_overlap("tickers", F.array(*map(F.lit, tickers))) & (F.col("available_at") <= cutoff))
    signal = F.round(F.coalesce("signal", F.lit(0.0)) + 0.25 * F.coalesce("upside", F.lit(0.0)) + 0.25 * F.coalesce("risk", F.lit(0.0)), 9)
    rows = found.join(features, "doc_id", "left").withColumn("order_score", signal)
    top = best(rows, [F.desc("available_at"), F.desc("order_score"), F.desc("credibility"), F.asc("doc_id")], n)
    return top.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


def quality_table(docs: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    """Documents, those with features, mean credibility and mean signal (none counts 0) of each group."""
    rows = docs.join(features.select("doc_id", "signal"), "doc_id", "left")
    return rows.groupBy(*by).agg(F.count("*").alias("documents"), F.count("signal").alias("with_features"), F.round(F.avg("credibility"), 6).alias("mean_credibility"), F.round(F.avg(F.coalesce("signal", F.lit(0.0))), 6).alias("mean_signal"))


def evidence_of(docs: DataFrame, ticker: str, n: int) -> DataFrame:
    """The newest n documents of a ticker, by what they are linked to or their title's words; of all documents where there are none."""
    hit = F.array_contains("tickers", ticker) | F.regexp_like(F.upper(F.coalesce("title", F.lit(""))), F.lit(rf"(^|[^A-Z0-9]){ticker.upper()}([^A-Z0-9]|$)"))
    rows = docs.withColumn("hit", hit)
    order = [F.desc("hit"), F.desc("available_at"), F.asc("doc_id")]
    top = best(rows, order, n)
    return top.withColumn("any_hit", F.max("hit").over(Window.partitionBy(F.lit(0)))).filter("hit OR NOT any_hit").drop("any_hit")


def favourite_status(rows: DataFrame, favourites: list[str], removed: list[str], added: list[str]) -> DataFrame:
    """Adds the site's key, its status among the favourites, and whether it stands out."""
    key = host(F.col("url"))
    within = lambda names: key.isin(*sorted(set(names))) if names else F.lit(False)
    status = F.when(within(removed), "pending_removed").when(within(added), "pending_added").when(within(favourites), "favorite").otherwise("not_favorite")
    return rows.withColumns({"favorite_site_key": key, "favorite_status": status, "favorite_highlight": within(favourites) & ~within(removed)})


def sites(urls: DataFrame) -> DataFrame:
    """The distinct sites of a list of addresses, in order."""
    return urls.select(host(F.col("url")).alias("site")).filter("site <> ''").distinct()


def post_relevance(text: Column, terms: list[str]) -> Column:
    """A point for each short term of a portfolio that stands in a post as a word, half a point for a long one, and a little for events."""
    low = F.lower(F.coalesce(text, F.lit("")))
    own = sum((F.when(F.regexp_like(low, F.lit(rf"(^|[^a-z0-9]){t}([^a-z0-9]|$)")), 1.0 if len(t) <= 5 else 0.5).otherwise(0.0) for t in terms), F.lit(0.0))
    events = sum((F.contains(low, F.lit(t)).cast("int") for t in EVENT_TERMS), F.lit(0))
    return F.round(F.when(low == "", 0.0).otherwise(own + 0.15 * events), 6)


def post_view(rows: DataFrame) -> DataFrame:
    """Posts for display: no body, but its length."""
    return rows.select("id", "site", "title", "published_at", F.substring(F.coalesce("summary", F.lit("")), 1, 500).alias("summary"), F.length(F.coalesce("body", F.lit(""))).alias("text_char_count"))


def context_text(rows: DataFrame) -> Column:
    """A retrieved document as lines for a language model."""
    line = lambda name, value: F.concat(F.lit(name + ": "), F.coalesce(value.cast("string"), F.lit("")))
    tickers = F.when(F.size("tickers") > 0, F.array_join("tickers", ", ")).otherwise("MARKET")
    return F.concat_ws(
        "\n", line("Document title", F.col("title")), line("Published at", F.col("published_at")), line("Available at", F.col("available_at")), line("Related tickers", tickers), line("Evidence scope", F.col("evidence_scope")),
        line("Portfolio exposure", F.col("portfolio_weight_sum")), line("Retrieval score", F.col("final_score")), line("Retrieval reasons", F.array_join("reasons", ", ")), line("Text excerpt", F.col("excerpt")),
    )


def statement_priority(kind: Column, title: Column, text: Column) -> Column:
    """Points for how likely a document holds a company's statements."""
    k, t = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    point = lambda test, n: F.when(test, n).otherwise(0)
    has = lambda c, w: F.contains(c, F.lit(w))
    return (
        point(has(k, "exhibit") | has(t, "earnings release"), 5) + point(has(t, "financial statements"), 5) + point(has(t, "management") | has(t, "mda"), 3)
        + point(F.coalesce(text, F.lit("")).rlike(r"(?i)\b(total net sales|total revenue|net income|earnings per share|gross margin)\b"), 5)
    )


#: Words of a post's tags that stand for events, and how much its type adds.
VIBE_EVENTS = ("earnings", "guidance", "risk", "rates", "inflation", "credit", "margin", "demand", "supply_chain", "legal_regulatory", "current_report", "8-k")
VIBE_TYPES = ((0.35, ("sec_filing_exhibit", "company_earnings_release")), (0.15, ("sec_filing_section", "company_press_release", "company_financial_report")))
VIBE_WEIGHTS = (("holding", 3.0), ("specific", 1.5), ("text", 1.0), ("event", 0.75), ("risk_terms", 0.35), ("quality", 0.20), ("signal", 1.20), ("edge", 0.35), ("usefulness", 2.0))


def vibe(weights: dict[str, float], tickers: Column, tags: Column, risk_terms: Column, kind: Column, credibility: Column, text: Column, signal: Column, up: Column, risk: Column, usefulness: Column) -> Column:
    """A post's score for a portfolio (ticker -> weight), by nine weighted components."""
    own = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    direct = F.array_intersect(tickers, F.array(*map(F.lit, weights)))
    held = F.least(F.lit(1.0), F.aggregate(direct, F.lit(0.0), lambda s, t: s + F.element_at(own, t)))
    low = F.array_distinct(F.transform(F.concat(tags, risk_terms), F.lower))
    event = F.least(F.lit(1.0), F.size(F.filter(low, lambda t: F.regexp_like(t, F.lit("|".join(VIBE_EVENTS))))) / 4.0)
    for more, kinds in VIBE_TYPES:
        event = F.when(F.lower(F.coalesce(kind, F.lit(""))).isin(*kinds), F.least(F.lit(1.0), event + more)).otherwise(event)
    parts = {
        "holding": held, "specific": F.when(F.size(direct) > 0, 1.0).otherwise(0.0), "text": text, "event": event, "risk_terms": F.least(F.lit(1.0), F.size(risk_terms) / 6.0), "quality": F.coalesce(credibility, F.lit(0.0)),
        "signal": F.coalesce(signal, F.lit(0.0)), "edge": F.greatest(F.coalesce(up, F.lit(0.0)), F.coalesce(risk, F.lit(0.0))), "usefulness": F.coalesce(usefulness, F.lit(0.0)),
    }
    return F.round(sum((w * parts[n] for n, w in VIBE_WEIGHTS), F.lit(0.0)), 6)


def result_excerpt(kind: Column, body: Column, tags: Column, at: Column, signal: Column, risk: Column, up: Column, macro: Column) -> Column:
    """What a result shows: a macro release's own words, its signals in a sentence, or the beginning of its text."""
    from tidemark.functions.text import excerpt

    label = F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise(F.replace(F.coalesce(F.nullif(kind, F.lit("")), F.lit("evidence")), F.lit("_"), F.lit(" ")))
    two = lambda c: F.coalesce(c, F.lit(0.0))
    said = F.format_string("Signal %.2f. Risk %.2f. Upside %.2f. %s evidence available %s.", two(signal), two(risk), two(up), label, F.substring(F.coalesce(at.cast("string"), F.lit("")), 1, 10))
    return F.when(F.lower(F.coalesce(kind, F.lit(""))).startswith("official_macro"), macro).when(two(signal) > 0, said).otherwise(excerpt(body, 220))


def site_records(docs: DataFrame, features: DataFrame, site: str, n: int) -> DataFrame:
    """The n documents of a site (and of hosts below it) with the strongest signals, then the newest, with how many there are in all."""
    key = host(F.col("url"))
    found = docs.filter((key == site) | key.endswith("." + site))
    score = F.round(F.coalesce("signal", F.lit(0.0)) + 0.35 * F.coalesce("upside", F.lit(0.0)) + 0.35 * F.coalesce("risk", F.lit(0.0)), 9)
    top = best(found.join(features, "doc_id", "left").withColumn("order_score", score), [F.desc("order_score"), F.desc("available_at"), F.desc("credibility"), F.asc("doc_id")], n)
    return top.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


def lookup(docs: DataFrame, keys: DataFrame, hashed: Column, url: str = "url") -> DataFrame:
    """The document that each key (key, kind: hash or url) names; null where there is none, the smallest doc_id where several do."""
    named = docs.select(hashed.alias("key"), F.lit("hash").alias("kind"), "doc_id").unionByName(docs.select(F.col(url).alias("key"), F.lit("url").alias("kind"), "doc_id"))
    first = named.join(keys, ["key", "kind"], "left_semi").groupBy("key", "kind").agg(F.min("doc_id").alias("doc_id"))
    return keys.join(first, ["key", "kind"], "left")


def folder_decision(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """Whether a query's results go into folders: three groups at least, and a company that it names."""
    n = groups.groupBy("query_id").agg(F.count_distinct("group_key").alias("groups"))
    named = entities.select("query_id").distinct().withColumn("named", F.lit(True))
    return n.join(named, "query_id", "left").withColumn("folders", (F.col("groups") >= 3) & F.coalesce("named", F.lit(False))).drop("named")
