"""What a search query asks for, how well a document's form fits it, and the groups that results fall into."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Terms = tuple[str, ...]
Rule = tuple[str, Terms]

#: Routes with their labels, reasons and the words that ask for them, in order.
SEC_TERMS = ("10-k", "10k", "10-q", "10q", "8-k", "8k", "filing", "filings", "annual", "quarterly", "md&a", "risk factors", "sec")
COMPANY_TERMS = ("earnings", "guidance", "presentation", "investor day", "press release", "buyback", "dividend", "margin", "revenue")
MACRO_TERMS = (
    "fed", "fomc", "rates", "rate", "yield", "yields", "inflation", "cpi", "pce", "payrolls", "unemployment", "credit spread", "treasury", "dxy", "oil", "housing",
    "mortgage", "ism",
)
NUMBER_TERMS = ("xbrl", "company facts", "eps", "ebitda", "cash flow", "free cash flow", "fcf", "revenue", "margin", "debt", "assets", "liabilities", "table", "number", "how much", "what was")
NEWS_TERMS = ("news", "sentiment", "mood", "twitter", "reddit", "google trends", "trend", "media", "headline")
PORTFOLIO_TERMS = ("portfolio", "holding", "holdings", "my stocks", "my positions", "risk", "exposure", "impact", "affect", "sensitivity")
FAVOURITE_TERMS = ("favorite", "preferred", "my vibe", "website", "blog", "post", "posts")
OUTSIDE_TERMS = ("reddit", "twitter", "x.com", "youtube", "telegram", "blog", "forum", "opinion")
FIELDS: tuple[Rule, ...] = (
    ("earnings", ("earnings", "eps", "profit", "net income", "guidance")),
    ("revenue", ("revenue", "sales", "top line")),
    ("capital_return", ("buyback", "repurchase", "dividend", "cash return")),
    ("credit", ("credit", "loan", "debt", "spread", "default", "deposit")),
    ("rates", ("fed", "rate", "rates", "yield", "treasury", "fomc")),
    ("inflation", ("inflation", "cpi", "pce", "prices")),
    ("labor", ("payrolls", "jobs", "unemployment", "wages")),
    ("housing", ("housing", "mortgage", "starts", "permits", "home sales")),
    ("energy", ("oil", "brent", "wti", "opec", "gas")),
    ("legal_regulatory", ("lawsuit", "investigation", "regulation", "sec", "doj", "ftc")),
)
#: What kind of discovery a query is after; the first that holds.
MODES: tuple[Rule, ...] = (
    ("risk", ("risk", "sell", "avoid", "danger", "downside", "warning")),
    ("opportunity", ("invest", "buy", "opportunity", "best stock", "which stock", "what stock", "signal")),
)
#: Topics of a query, every one whose words stand in it.
TOPICS: tuple[Rule, ...] = (
    ("earnings_guidance", ("earnings", "guidance", "eps", "results of operations")),
    ("company_risk", ("risk", "risk factors", "litigation", "lawsuit", "legal", "regulatory", "supply chain")),
    ("legal_regulatory", ("litigation", "lawsuit", "legal proceedings", "regulatory")),
    ("supply_chain", ("supply chain",)),
    ("energy", ("energy", "oil", "wti", "crude", "commodity demand")),
    ("consumer_demand", ("consumer demand", "consumer spending", "spending", "payments demand", "card spending")),
    ("bank_credit", ("bank", "banks", "banking", "credit cycle", "credit risk")),
    ("margin_pressure", ("margin", "margins", "profitability", "cost pressure")),
)
#: Words of a document's fields that fit a topic, and the points they give.
FITTING: tuple[tuple[str, Terms, float], ...] = (
    ("company_risk", ("risk factors", "company risk", "market risk", "legal regulatory", "legal proceedings", "mda", "management s discussion"), 5.0),
    ("legal_regulatory", ("legal regulatory", "legal proceedings", "litigation", "lawsuit", "regulatory"), 4.0),
    ("supply_chain", ("supply chain", "supplier", "production", "inventory", "company risk", "mda"), 3.0),
    ("energy", ("energy", "oil", "commodity", "market risk", "risk factors"), 4.0),
    ("consumer_demand", ("consumer demand", "consumer spending", "card member spending", "sales", "revenue"), 4.0),
    ("bank_credit", ("credit", "loan", "deposit", "financial statements", "mda", "company risk"), 3.0),
    ("margin_pressure", ("margin pressure", "operating income", "gross margin", "cost", "mda"), 4.0),
)
GUIDANCE_FORMS = ("earnings guidance", "earnings release", "results of operations", "item 2.02")
EARNINGS_FORMS, RISK_FORMS = ("earnings guidance", "earnings release"), ("risk", "legal", "supply chain")
#: Fixed values: (folder, points where the query has an entity, where it has none, words); of one folder and number the first that holds.
DEMANDS: tuple[tuple[str, int, float, float, Terms], ...] = (
    ("sec_filings", 1, 4.0, 4.0, ("10-k", "10k", "10-q", "10q", "8-k", "8k", "filing", "filings", "sec", "annual report", "quarterly report")),
    ("sec_filings", 2, 4.0, 0.0, ("risk", "risk factor", "risk factors", "litigation", "lawsuit", "legal", "legal proceedings", "regulatory", "market risk", "credit risk", "supply chain")),
    ("sec_filings", 2, 2.0, 2.0, ("risk factor", "risk factors", "litigation", "lawsuit", "legal proceedings", "regulatory", "market risk", "credit risk")),
    ("sec_filings", 3, 3.0, 0.0, ("margin", "margins", "revenue", "sales", "cloud", "mda", "md&a", "financial statements", "cash flow", "debt", "balance sheet", "income statement", "operating income", "net income", "eps")),
    ("sec_filings", 3, 1.5, 1.5, ("mda", "md&a", "financial statements", "cash flow", "debt", "balance sheet", "income statement", "operating income", "net income")),
    ("sec_filings", 4, 2.5, 0.0, ("energy demand", "oil demand", "commodity demand")),
    ("macro", 1, 4.0, 4.0, ("fed", "fomc", "macro", "treasury", "yield", "yields", "rate", "rates", "inflation", "cpi", "pce", "vix", "spread", "oil", "unemployment", "payrolls", "housing")),
)
COMPANY_DEMAND = ("earnings", "guidance", "press release", "presentation", "investor day", "buyback", "dividend", "product launch", "launch")
SPENDING_DEMAND = ("consumer spending", "card spending", "payments demand")
EXHIBIT_EVENTS = ("earnings", "guidance", "investor", "press release")
#: Words that name no company in a query, and those that name none in a company's name.
PLAIN_WORDS = ("a", "about", "an", "and", "are", "as", "at", "be", "best", "buy", "can", "for", "from", "how", "i", "in", "into", "invest", "investment", "is", "me", "of", "on", "or", "should", "stock", "stocks", "the", "to", "what", "which", "with", "corporation", "company", "inc", "group")
QUERY_WORDS = ("10k", "10q", "8k", "archive", "archives", "event", "events", "filing", "filings", "ir", "macro", "press", "release", "releases", "report", "reports", "risk", "risks", "sec", "signal", "signals")
NAME_WORDS = ("co", "corp", "incorporated", "ltd", "plc")
#: Rewrites of a title, one after another, that leave what copies of a report share.
TITLE_REWRITES = (
    ("&", " and "),
    (r"\bfiled\s+\d{4}-\d{2}-\d{2}\b", "filed"),
    (r"\b\d{4}-\d{2}-\d{2}\b", " "),
    (r"\b(19|20)\d{2}\b", " "),
    (r"\bq[1-4]\s*(fy)?\s*\d{2,4}\b", "quarter"),
    (r"\b(first|second|third|fourth)\s+quarter\s+\d{2,4}\b", "$1 quarter"),
    (r"\bfiscal\s+\d{2,4}\b", "fiscal"),
    (r"\bitem\s+([0-9]+)\s*([a-z])\b", "item $1$2"),
    (r"[^a-z0-9]+", " "),
)
#: Character references that titles hold.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&rsquo;", "’"), ("&#8217;", "’"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"))


def squeezed(text: Column) -> Column:
    """Lower-case words with one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def has_any(text: Column, terms: Terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def held(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(has_any(text, terms), F.lit(name)) for name, terms in rules]))


def first_held(text: Column, rules: tuple[Rule, ...], default: str = "") -> Column:
    out = F.lit(default)
    for name, terms in reversed(rules):
        out = F.when(has_any(text, terms), F.lit(name)).otherwise(out)
    return out


def query_intent(rows: DataFrame, query: Column, has_entity: Column) -> DataFrame:
    """Adds routes, kb_labels, field_labels, reasons, primary_intent, numeric, outside and confidence of a query to each row."""
    q = squeezed(query)
    sec, company, macro, number, news, mine, favourite, outside = (has_any(q, t) for t in (SEC_TERMS, COMPANY_TERMS, MACRO_TERMS, NUMBER_TERMS, NEWS_TERMS, PORTFOLIO_TERMS, FAVOURITE_TERMS, OUTSIDE_TERMS))
    numeric = number | q.rlike(r"\d")
    steps = (
        (sec, "sec_filings", "filings", "sec_filing_language"), (company, "company_ir", "company_events", "company_ir_language"), (macro, "official_macro", "macro_data", "macro_language"),
        (numeric, "structured_facts", "numeric_or_table_data", "structured_numeric_language"), (news, "market_news", "market_news_and_sentiment", "news_or_sentiment_language"),
        (favourite, "favorite_websites", "user_favorite_sources", "favorite_source_language"), (outside, "external_web", "external_or_untrusted_sources", "external_source_language"),
    )
    some = lambda k: F.array_compact(F.array(*[F.when(s[0], F.lit(s[k])) for s in steps]))
    none = F.size(some(1)) == 0
    instead = lambda company_, other: F.when(has_entity, F.array(F.lit(company_))).otherwise(F.array(F.lit(other)))
    primary = (
        F.when(mine, "portfolio_impact").when(sec & number, "filing_fact_lookup").when(sec, "filing_search").when(number, "structured_numeric_lookup").when(macro, "macro_regime_lookup")
        .when(news | outside, "news_sentiment_lookup").when(favourite, "favorite_source_lookup").when(has_entity, "company_event_search").otherwise("general_financial_search")
    )
    fields = held(q, FIELDS)
    signals = reduce(lambda a, b: a + b, [t.cast("int") for t in (sec, company, macro, number, news, mine, favourite, outside, has_entity)])
    confidence = F.least(F.lit(0.95), 0.35 + 0.10 * signals + 0.05 * F.least(F.size(fields), F.lit(3)))
    extra = F.array_compact(F.array(F.when(has_entity, F.lit("dow30_entity_match")), F.when(mine, F.lit("portfolio_context_language"))))
    return rows.withColumns({
        "routes": F.when(none, instead("company_ir", "local_corpus")).otherwise(some(1)), "kb_labels": F.when(none, instead("company_events", "general_financial_text")).otherwise(some(2)), "field_labels": fields,
        "reasons": F.concat(some(3), extra), "primary_intent": primary, "numeric": numeric, "outside": outside | favourite, "confidence": F.round(F.when(q == "", 0.0).otherwise(confidence), 3),
    })


def field_alignment(query: Column, fields: Column, kind: Column, tickers: Column, credit: Column, financial: Column) -> Column:
    """Points for how a document's title, type and tags fit the topics of a query; credit and financial are lists of tickers."""
    q, kind = squeezed(query), F.lower(F.coalesce(kind, F.lit("")))
    asks = {name: has_any(q, terms) for name, terms in TOPICS}
    gives = lambda topic, test, points: F.when(asks[topic] & test, points).otherwise(0.0)
    companies = F.size(tickers) > 0
    earnings = F.when(has_any(fields, GUIDANCE_FORMS), 5.0).when(F.contains(fields, F.lit("earnings release candidate")), 3.0).when(kind.startswith("company_") & F.contains(fields, F.lit("press release")), -2.0).otherwise(0.0)
    out = F.when(asks["earnings_guidance"], earnings).otherwise(0.0)
    for topic, terms, points in FITTING:
        out = out + gives(topic, has_any(fields, terms), points)
    out = out + gives("company_risk", has_any(fields, EARNINGS_FORMS) & ~has_any(fields, RISK_FORMS), -7.0)
    out = out + gives("consumer_demand", kind.startswith("official_macro") & F.contains(fields, F.lit("credit")) & ~F.contains(fields, F.lit("consumer")), -3.0)
    lenders = F.when(F.arrays_overlap(tickers, credit), 5.0).when(companies & ~F.arrays_overlap(tickers, financial), -4.0).otherwise(0.0)
    return out + F.when(asks["bank_credit"], lenders).otherwise(0.0)


def intent_weights(query: Column, routes: Column, has_entity: Column) -> dict[str, Column]:
    """What each folder of sources weighs for a query."""
    q = squeezed(query)
    routed = lambda route, points: F.when(F.array_contains(routes, route), points).otherwise(0.0)
    out = {"sec_filings": routed("sec_filings", 3.0), "macro": routed("official_macro", 3.5), "news": routed("market_news", 1.5)}
    for folder, number in dict.fromkeys((d[0], d[1]) for d in DEMANDS):
        points = F.lit(0.0)
        for _, _, with_entity, without, terms in reversed([d for d in DEMANDS if d[:2] == (folder, number)]):
            own = F.when(has_entity, with_entity).otherwise(without)
            points = F.when(has_any(q, terms) & (own > 0), own).otherwise(points)
        out[folder] = out[folder] + points
    # Where nothing else is asked of a company, its own pages; macro's demands count later than this test.
    early = (out["sec_filings"] > 0) | F.array_contains(routes, "official_macro") | (out["news"] > 0)
    pages = F.when(has_any(q, COMPANY_DEMAND), 3.0).when(F.array_contains(routes, "company_ir") | (has_entity & ~early), 0.75).otherwise(0.0)
    pages = pages + F.when(has_entity & has_any(q, SPENDING_DEMAND), 2.5).otherwise(0.0)
    sec = out["sec_filings"]
    return {"sec_filings": sec + F.when(has_entity & (sec > 0), 1.0).otherwise(0.0), "company_ir": pages + F.when(has_entity & (pages > 0), 0.75).otherwise(0.0), "macro": out["macro"], "news": out["news"], "other_sources": F.lit(0.0)}


def intent_boost(query: Column, weights: dict[str, Column], folder: Column, kind: Column, events: Column) -> Column:
    """A document's points by its folder; a little less than none where the query clearly wants another folder."""
    most = F.greatest(*weights.values())
    own = F.lit(0.0)
    for name, w in weights.items():
        own = F.when(folder == name, w).otherwise(own)
    exhibit = (F.lower(kind) == "sec_filing_exhibit") & (weights["company_ir"] > weights["sec_filings"]) & has_any(F.lower(F.array_join(events, " ")), EXHIBIT_EVENTS)
    own = F.when(exhibit, F.greatest(own, weights["company_ir"] - 0.5)).otherwise(own)
    own = F.when((own <= 0) & (most >= 3.0), own - F.least(F.lit(1.0), most * 0.15)).otherwise(own)
    return F.when((squeezed(query) == "") | (most <= 0), 0.0).otherwise(F.round(own, 6))


def folder_of(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.startswith("sec_filing"), "sec_filings").when(k.startswith("official_macro"), "macro").when(k.startswith("company_"), "company_ir").when(F.contains(k, F.lit("news")) | F.contains(k, F.lit("headline")), "news").otherwise("other_sources")


def group_title(title: Column) -> Column:
    """What copies and editions of a report share of their titles."""
    out = F.coalesce(title, F.lit(""))
    for name, text in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(text))
    out = F.lower(out)
    for pattern, by in TITLE_REWRITES:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


FILED = r"(?i)^(.+?\b(?:10-K|10-Q|8-K)\s+filing filed\s+\d{4}-\d{2}-\d{2})\s+-\s+(?:Item|Exhibit)\b"


def group_key(doc_id: Column, kind: Column, title: Column, tickers: Column) -> Column:
    """Results of one filing, all macro releases, or copies of a report by company and type, as one group."""
    k, doc = F.lower(F.coalesce(kind, F.lit(""))), F.coalesce(doc_id.cast("string"), F.lit(""))
    filed = F.regexp_extract(title, FILED, 1)
    shown = F.when(filed == "", title).otherwise(filed)
    accession = F.when(F.contains(doc, F.lit("__")), F.substring_index(doc, "__", 1)).otherwise("")
    filing = F.concat(F.lit("sec_filing|"), F.when(accession == "", group_title(shown)).otherwise(accession))
    own = F.array_sort(F.filter(F.transform(F.coalesce(tickers, F.array().cast("array<string>")), F.upper), lambda t: t != "MARKET"))
    usual = F.concat(F.array_join(own, ","), F.lit("|"), k, F.lit("|"), group_title(title))
    raw = F.when(k.startswith("official_macro"), "official_macro_snapshots").when(k.startswith("sec_filing"), filing).otherwise(usual)
    return F.concat(F.lit("g_"), F.substring(F.sha1(raw), 1, 16))


def name_words(text: Column, plain: Terms) -> Column:
    words = F.split(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*plain))


def _prefixes(text: Column, least: int, kind: str) -> Column:
    """kind:prefix for every prefix of at least that length."""
    cut = F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length(text))), lambda n: F.concat(F.lit(kind + ":"), F.substring(text, F.lit(1), n)))
    return F.when(F.length(text) >= least, cut).otherwise(F.array().cast("array<string>"))


def query_entities(queries: DataFrame, names: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, ticker): companies that a query names by ticker, name, first words or their beginnings.

    Every way to match is an equality of keys (w: a word, p: a whole query that begins a name, q: a name that begins the query), so queries
    and names meet in one equi-join.
    """
    q = queries.select(query_id, F.filter(name_words(F.col("query"), PLAIN_WORDS + QUERY_WORDS), lambda w: F.length(w) >= 2).alias("words")).filter(F.size("words") > 0)
    phrases = F.array_distinct(F.array(F.array_join("words", " "), F.array_join("words", "")))
    q_keys = F.flatten(F.array(
        F.transform("words", lambda w: F.concat(F.lit("w:"), w)), F.transform(phrases, lambda p: F.concat(F.lit("p:"), p)), F.flatten(F.transform(phrases, lambda p: _prefixes(p, 3, "q"))),
    ))
    n = names.select("ticker", F.lower("ticker").alias("low"), F.filter(name_words(F.col("name"), PLAIN_WORDS + NAME_WORDS), lambda w: F.length(w) >= 2).alias("words"))
    two = F.slice("words", 1, 2)
    aliases = F.when(F.size("words") > 0, F.array_distinct(F.array(F.col("low"), F.array_join("words", " "), F.array_join("words", ""), F.get("words", F.lit(0)), F.array_join(two, " "), F.array_join(two, "")))).otherwise(F.array("low"))
    n = n.withColumn("aliases", F.filter(aliases, lambda a: a != ""))
    long = F.filter("aliases", lambda a: F.length(a) >= 3)
    n_keys = F.flatten(F.array(
        F.array(F.concat(F.lit("w:"), F.col("low"))), _prefixes(F.col("low"), 2, "w"), F.transform("words", lambda w: F.concat(F.lit("w:"), w)), F.flatten(F.transform("words", lambda w: _prefixes(w, 3, "w"))),
        F.transform(F.filter("aliases", lambda a: F.length(a) >= 2), lambda a: F.concat(F.lit("p:"), a)), F.flatten(F.transform(long, lambda a: _prefixes(a, 1, "p"))), F.transform(long, lambda a: F.concat(F.lit("q:"), a)),
    ))
    left = q.select(query_id, F.explode(F.array_distinct(q_keys)).alias("key"))
    right = n.select("ticker", F.explode(F.array_distinct(n_keys)).alias("key"))
    return left.join(right, "key").select(query_id, "ticker").distinct()


def compact_tags(tickers: Column, signals: Column, events: Column, most: int = 3) -> Column:
    """Tickers, then signals and events as titles, without repeats and without those that say nothing."""
    own = F.filter(F.transform(tickers, F.upper), lambda t: (t != "") & (t != "MARKET"))
    clean = F.transform(F.concat(signals, events), lambda t: F.initcap(F.trim(F.replace(F.regexp_replace(t, "^signal_", ""), F.lit("_"), F.lit(" ")))))
    told = F.filter(clean, lambda t: (t != "") & (F.upper(t) != "MARKET") & ~t.isin("Filing", "Sec Section", "Sec Filing", "Document"))
    return F.slice(F.array_distinct(F.concat(own, told)), 1, most)
