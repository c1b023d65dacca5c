"""Features of a query and a result for a linear reranker, and rules that label how well a result answers its query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.search import EARNINGS_FORMS, FITTING, GUIDANCE_FORMS, RISK_FORMS, TOPICS, Terms, has_any, squeezed

#: Tickers of lenders, as the labels' and the reranker's rules have them.
LENDERS = ("AXP", "GS", "JPM", "TRV", "V")
BANKS = ("JPM", "GS", "AXP", "TRV")
#: Fixed values: (feature, topics of the query that want it, words of the document).
SECTIONS: tuple[tuple[str, Terms, Terms], ...] = (
    ("risk_factor_section_match", ("company_risk", "legal_regulatory", "supply_chain"), ("item 1a", "risk factors")),
    ("legal_section_match", ("company_risk", "legal_regulatory", "supply_chain"), ("legal proceedings", "legal regulatory", "litigation", "lawsuit", "regulatory")),
    ("mda_section_match", ("company_risk", "legal_regulatory", "supply_chain", "energy", "margin_pressure"), ("mda", "management's discussion", "management s discussion", "management discussion", "item 7 management", "item 2 management")),
    ("earnings_release_match", ("earnings_guidance", "margin_pressure", "energy"), ("earnings release", "investor material")),
    ("results_item_match", ("earnings_guidance", "margin_pressure"), ("item 2.02", "results of operations", "financial condition")),
    ("item_901_wrapper", ("earnings_guidance", "margin_pressure", "company_risk", "legal_regulatory", "supply_chain"), ("item 9.01", "financial statements and exhibits")),
    ("financial_statement_section", ("company_risk", "legal_regulatory", "supply_chain", "margin_pressure"), ("financial statements", "consolidated financial statements", "statement of income")),
    ("energy_theme_match", ("energy",), ("energy", "oil", "crude", "commodity", "wti")),
)
UNRELATED = ("health records", "news app", "environmental", "impact accelerator", "privacy", "education")
#: Words of a result that its query's intent looks for.
SEC_HINTS = ("10-k", "10k", "10-q", "10q", "8-k", "8k", "filing", "sec", "item ", "mda", "md&a", "financial statements")
RISK_HINTS = ("risk", "risk factors", "litigation", "lawsuit", "legal", "legal proceedings", "regulatory", "market risk", "credit risk", "supply chain")
EVENT_HINTS = ("earnings", "guidance", "8-k", "current report", "press release", "investor material", "presentation", "product", "launch", "dividend", "buyback")
FUNDAMENTAL_HINTS = ("revenue", "sales", "margin", "cloud", "financial statements", "mda", "md&a", "operating income", "net income", "eps", "debt", "cash flow", "gross profit")
MACRO_HINTS = (
    "macro", "fed", "fomc", "treasury", "yield", "rate", "rates", "inflation", "cpi", "pce", "spread", "vix", "volatility", "oil", "unemployment", "payrolls", "consumer", "demand",
    "housing", "recession",
)
#: An exhibit that reads like a company's own material.
OWN_MATERIAL = ("earnings", "guidance", "press release", "investor material", "presentation")
#: Fixed values: (intent, families it takes, words it looks for).
INTENT_RULES: tuple[tuple[str, Terms, Terms], ...] = (
    ("company_filings", ("sec_filings",), SEC_HINTS),
    ("company_risk", ("sec_filings",), RISK_HINTS),
    ("company_events", ("sec_filings", "company_ir"), EVENT_HINTS),
    ("company_fundamentals", ("sec_filings", "company_ir"), FUNDAMENTAL_HINTS),
    ("company_macro", ("sec_filings", "company_ir", "macro"), MACRO_HINTS + FUNDAMENTAL_HINTS),
)
#: Words of the reviewer's rules, by what they show.
DIRECT_EVENT = ("earnings release", "earnings guidance", "results of operations", "financial condition", "exhibit 99", "guidance")
NEAR_EVENT = ("management discussion", "mda", "financial statements", "income statement", "operating income")
DIRECT_RISK = ("risk factors", "item 1a", "litigation", "legal proceedings", "lawsuit", "regulatory", "credit risk", "company risk", "supply chain")
NEAR_RISK = ("market risk", "management discussion", "mda", "financial condition", "credit", "debt")
DIRECT_FUNDAMENTAL = ("margin", "operating income", "income statement", "segment revenue", "earnings release", "results of operations", "financial statements", "mda", "management discussion", "cloud")
NEAR_FUNDAMENTAL = ("10-k", "10-q", "8-k", "financial condition", "market risk")
TOPICAL = ("energy", "oil", "demand", "consumer", "spending", "payment", "revenue", "earnings", "macro")
BANK_WORDS = ("credit", "risk", "financial", "10-k", "10-q", "bank")
#: Macro queries and the words that answer them, then those that come near.
MACRO_DIRECT: tuple[tuple[str, Terms], ...] = (
    ("web_10y_2y_spread", ("10-year minus 2-year", "10 year 2 year", "t10y2y", "yield curve", "2-year")),
    ("web_yield_curve", ("yield curve", "10-year minus 2-year", "10-year minus 3-month", "spread", "treasury")),
    ("web_vix", ("vix", "volatility")),
    ("web_high_yield_spread", ("high yield", "credit spread", "bofa", "spread")),
    ("web_wti_oil", ("wti", "crude", "oil")),
    ("web_unemployment", ("unemployment", "employment", "labor")),
    ("web_inflation", ("inflation", "cpi", "consumer price")),
)
RATE_WORDS = ("rate", "yield", "treasury", "spread")
DEMAND_WORDS = ("consumer", "demand", "spending", "retail", "unemployment", "employment")
APPETITE_WORDS = ("vix", "risk appetite", "credit spread", "yield", "earnings", "financial condition")


def text_of(*fields: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def scope_matches(scope: Column, kind: Column, folder: Column) -> dict[str, Column]:
    """Whether a result is of the source that its query is after, by source."""
    k, f = F.lower(F.coalesce(kind, F.lit(""))), F.coalesce(folder, F.lit(""))
    return {"sec_filings": (scope == "sec_filings") & (k.startswith("sec_") | (f == "sec_filings")), "macro": (scope == "macro") & k.startswith("official_macro"), "company_ir": (scope == "company_ir") & (k.startswith("company_") | (f == "company_ir"))}


def wrong_company(expected: Column, tickers: Column) -> Column:
    """Another company than the one asked for, and not the market as a whole."""
    e = F.upper(F.coalesce(expected, F.lit("")))
    return (e != "") & (e != "MARKET") & (F.size(tickers) > 0) & ~F.array_contains(tickers, e) & ~F.array_contains(tickers, "MARKET")


def scope_mismatch(scope: Column, kind: Column, folder: Column) -> Column:
    own = scope_matches(scope, kind, folder)
    return scope.isin(*own) & ~(own["sec_filings"] | own["macro"] | own["company_ir"])


def human_reviewed(source: Column, annotator: Column) -> Column:
    return F.lower(F.coalesce(source, F.lit(""))).startswith("human_") | F.lower(F.coalesce(annotator, F.lit(""))).isin("user_chat", "human", "reviewer_1")


def rerank_features(rows: DataFrame) -> DataFrame:
    """Adds eleven base and ten section features to rows of a query (query, source_scope, expected_ticker) and a result."""
    q, kind = squeezed(F.col("query")), F.lower(F.coalesce("source_type", F.lit("")))
    text = F.translate(text_of("title", "source_type", "event_tags", "risk_terms", "excerpt"), "_’`", " ''")
    asks = {name: has_any(q, terms) for name, terms in TOPICS}
    expected, tickers = F.upper(F.coalesce("expected_ticker", F.lit(""))), F.col("tickers")
    press = kind.startswith("company_") & F.contains(text, F.lit("press release"))
    lender = F.arrays_overlap(tickers, F.array(*map(F.lit, LENDERS)))
    other = ~lender & (F.size(tickers) > 0) & ~F.array_contains(tickers, "MARKET")
    exact, bad = _flag(asks["earnings_guidance"] & has_any(text, GUIDANCE_FORMS)), _flag(asks["earnings_guidance"] & ~has_any(text, GUIDANCE_FORMS) & press)
    for topic, terms, _ in FITTING:
        exact = exact + _flag(asks[topic] & has_any(text, terms))
    exact = exact + _flag(asks["bank_credit"] & lender)
    bad = bad + _flag(asks["company_risk"] & has_any(text, EARNINGS_FORMS) & ~has_any(text, RISK_FORMS)) + _flag(asks["bank_credit"] & other)
    wanted = {name: has_any(q, tuple(t for topic, terms in TOPICS if topic in topics for t in terms)) for name, topics, _ in SECTIONS}
    found = {name: has_any(text, terms) for name, _, terms in SECTIONS}
    risk = wanted["risk_factor_section_match"]
    own = scope_matches(F.col("source_scope"), F.col("source_type"), F.col("folder_key"))
    title = F.replace(F.lower(F.coalesce("title", F.lit(""))), F.lit("’"), F.lit("'"))
    return rows.withColumns({
        "base_score": F.coalesce(F.col("score").cast("double"), F.lit(0.0)), "signal": F.coalesce(F.col("signal_strength").cast("double"), F.lit(0.0)), "rank_prior": 1 / F.greatest(F.lit(1.0), F.coalesce(F.col("rank").cast("double"), F.lit(1.0))),
        "expected_ticker_match": _flag((expected != "") & (expected != "MARKET") & F.array_contains(tickers, expected)), "wrong_company": _flag(wrong_company(F.col("expected_ticker"), tickers)),
        "source_scope_match": _flag(own["sec_filings"] | own["macro"] | own["company_ir"]), "sec_scope_match": _flag(own["sec_filings"]), "macro_scope_match": _flag(own["macro"]), "company_ir_scope_match": _flag(own["company_ir"]),
        "field_exact": exact, "field_bad": bad, **{name: _flag(wanted[name] & found[name]) for name in wanted},
        "risk_query_earnings_release_bad": _flag(risk & found["earnings_release_match"] & ~(found["risk_factor_section_match"] | found["legal_section_match"] | found["mda_section_match"])),
        "nonfinancial_press_bad": _flag(asks["earnings_guidance"] & kind.startswith("company_") & has_any(title, UNRELATED)),
    })


def matches(rows: DataFrame) -> DataFrame:
    """Adds source_match, entity_match and intent_match of a result with its query (source_scope, expected_ticker, intent)."""
    text = text_of("query", "title", "group_title", "folder_title", "source_type", "event_tags", "risk_terms", "excerpt")
    scope, family, intent = F.lower(F.trim(F.coalesce("source_scope", F.lit("")))), F.col("family"), F.lower(F.trim(F.coalesce("intent", F.lit(""))))
    exhibit = (F.lower(F.coalesce("source_type", F.lit(""))) == "sec_filing_exhibit") & has_any(text, OWN_MATERIAL)
    source = F.when(scope == "sec_filings", family == "sec_filings").when(scope == "company_ir", (family == "company_ir") | exhibit).when(scope == "macro", family == "macro").otherwise(family.isin("sec_filings", "company_ir", "macro"))
    expected, found = F.upper(F.trim(F.coalesce("expected_ticker", F.lit("")))), F.array_union("tickers", "holdings")
    named = F.regexp_like(F.upper(F.concat_ws(" ", "title", "group_title")), F.concat(F.lit("(^|[^A-Z0-9])"), expected, F.lit("($|[^A-Z0-9])")))
    entity = F.when(expected == "", True).when(expected == "MARKET", F.array_contains(found, "MARKET") | (family == "macro")).otherwise(F.array_contains(found, expected) | named)
    fits = F.when(intent.startswith("macro_"), (family == "macro") & has_any(text, MACRO_HINTS)).when(intent.isin("portfolio_macro", "portfolio_sector"), (family == "macro") | has_any(text, MACRO_HINTS)).otherwise(has_any(text, SEC_HINTS + EVENT_HINTS + MACRO_HINTS + FUNDAMENTAL_HINTS))
    for name, families, terms in reversed(INTENT_RULES):
        fits = F.when(intent == name, family.isin(*families) & has_any(text, terms)).otherwise(fits)
    return rows.withColumns({"source_match": source, "entity_match": entity, "intent_match": fits})


def grades(rows: DataFrame) -> DataFrame:
    """Adds relevance, 0 to 3 by how many of the three matches hold; 1 at most where the company or the source asked for is wrong."""
    rows = matches(rows)
    asked, scope = F.upper(F.trim(F.coalesce("expected_ticker", F.lit("")))), F.trim(F.coalesce("source_scope", F.lit("")))
    votes = F.col("source_match").cast("int") + F.col("entity_match").cast("int") + F.col("intent_match").cast("int")
    wrong = ((asked != "") & (asked != "MARKET") & ~F.col("entity_match")) | ((scope != "") & ~F.col("source_match"))
    return rows.withColumn("relevance", F.when(wrong, F.least(votes, F.lit(1))).otherwise(votes))


def _graded(*steps: tuple[Column | None, int | Column, str]) -> tuple[Column, Column]:
    """Grade and reason of the first step whose test holds; the last has none."""
    *tests, (_, last, why) = steps
    grade, reason = F.lit(last) if isinstance(last, int) else last, F.lit(why)
    for test, n, text in reversed(tests):
        grade, reason = F.when(test, n).otherwise(grade), F.when(test, F.lit(text)).otherwise(reason)
    return grade, reason


def reviewer_labels(rows: DataFrame, overwrite: bool = False) -> DataFrame:
    """Adds human_relevance and reviewer_notes by a reviewer's rules where there is no label, or everywhere with `overwrite`."""
    text, about, where = text_of("title", "event_tags", "excerpt", "source_type", "folder_key"), text_of("source_type", "folder_key", "event_tags"), text_of("source_type", "folder_key")
    query, qid, intent = text_of("query"), F.coalesce("query_id", F.lit("")), F.lower(F.coalesce("intent", F.lit("")))
    tickers, expected, scope = F.col("tickers"), F.upper(F.coalesce("expected_ticker", F.lit(""))), F.lower(F.coalesce("source_scope", F.lit("")))
    macro, sec, company = F.contains(about, F.lit("macro")), F.contains(where, F.lit("sec_filing")), has_any(about, ("company_", "company ir", "company official"))
    asked = F.when(expected == "MARKET", F.array_contains(tickers, "MARKET") | macro).otherwise(F.array_contains(tickers, expected))
    banks = F.arrays_overlap(tickers, F.array(*map(F.lit, BANKS)))
    form, own, credit_cycle = text_of("title", "event_tags"), sec | company, qid == "web_banks_credit_cycle"
    wants = lambda t: F.contains(query, F.lit(t))
    topical, demand, bank_words = has_any(text, TOPICAL), has_any(text, DEMAND_WORDS), has_any(text, BANK_WORDS)
    filings = _graded(
        (~asked, 0, "wrong company for filing query"), (wants("10-q") & F.contains(form, F.lit("10-q")), 3, "exact 10-Q filing"), (wants("10-q") & has_any(form, ("10-k", "8-k")), 2, "same issuer SEC filing but not requested 10-Q"),
        (wants("10-q"), 1, "same issuer but not a direct 10-Q filing"), (sec, 3, "same issuer SEC filing"), (company, 1, "same issuer but not SEC filing"), (None, 0, "not a filing source"),
    )
    events = _graded(
        (~asked, 0, "wrong company for event query"), (wants("8-k") & F.contains(text, F.lit("8-k")), 3, "requested company 8-K/current report"), (wants("8-k") & sec, 2, "same company SEC filing but not exact 8-K"),
        (wants("8-k"), 1, "same company event source but not SEC 8-K"), (has_any(text, DIRECT_EVENT), 3, "same company earnings/guidance evidence"), (has_any(text, NEAR_EVENT), 2, "same company financial context for guidance query"),
        (own, 1, "same company event source but weak earnings/guidance match"), (None, 0, "wrong source for event query"),
    )
    risk = _graded(
        (~asked & credit_cycle & banks, 2, "bank-sector credit evidence but not target bank"), (~asked, 0, "wrong company for risk query"), (has_any(text, DIRECT_RISK), 3, "direct risk evidence for target company"),
        (has_any(text, NEAR_RISK), 2, "risk-adjacent target-company filing"), (own, 1, "target-company document with weak risk match"), (None, 0, "wrong source for risk query"),
    )
    fundamentals = _graded(
        (~asked, 0, "wrong company for fundamentals query"), (has_any(text, DIRECT_FUNDAMENTAL), 3, "target-company financial or margin evidence"), (has_any(text, NEAR_FUNDAMENTAL), 2, "target-company SEC filing with indirect fundamentals evidence"),
        (own, 1, "target-company document with weak fundamentals match"), (None, 0, "wrong source for fundamentals query"),
    )
    exposure = _graded(
        (asked & topical, 3, "target-company macro-sensitive evidence"), (asked & own, 2, "target-company source with indirect macro exposure"), (macro & topical, 2, "macro source relevant to company exposure"), (None, 0, "wrong entity or weak macro match"),
    )
    series = _graded(
        (~macro, 0, "not an official macro source"), *[((qid == name) & has_any(text, terms), 3, "direct official macro series match") for name, terms in MACRO_DIRECT],
        ((qid == "web_inflation") & has_any(text, ("oil", "wti", "energy")), 2, "inflation-adjacent price-pressure series"), ((qid == "web_unemployment") & has_any(text, ("demand", "consumer", "growth")), 2, "growth-demand macro proxy"),
        (None, 1, "official macro source but weak query-specific match"),
    )
    by_source = lambda a, b: F.when(macro, a).otherwise(b)
    rates, consumers, appetite = qid == "web_portfolio_rates", qid == "web_consumer_demand", qid == "web_earnings_risk"
    whole = _graded(
        (~(macro | own), 0, "unsupported source for portfolio macro query"), (rates & macro & has_any(text, RATE_WORDS), 3, "direct rates evidence for portfolio risk"), (rates, 1, "weak portfolio-rates match"),
        (consumers & demand, by_source(3, 2), "consumer-demand evidence"), (consumers & macro, 1, "macro source with weak demand match"), (consumers, 0, "not consumer-demand evidence"),
        (appetite & has_any(text, APPETITE_WORDS), by_source(3, 2), "earnings/risk-appetite evidence"), (appetite, by_source(1, 0), "weak earnings-risk match"), (~macro, 1, "portfolio macro query with non-macro source"), (None, -1, ""),
    )
    whole = (F.when(whole[0] < 0, series[0]).otherwise(whole[0]), F.when(whole[0] < 0, series[1]).otherwise(whole[1]))
    yields = qid == "web_it_real_yields"
    sector = _graded(
        (credit_cycle & F.array_contains(tickers, "JPM") & bank_words, 3, "target bank credit-cycle evidence"), (credit_cycle & banks & bank_words, 2, "bank-sector credit-cycle evidence"), (credit_cycle, 0, "not bank credit-cycle evidence"),
        (yields & macro & has_any(text, RATE_WORDS), 3, "rate/yield evidence relevant to growth stocks"), (yields & macro, 2, "macro evidence indirectly relevant to growth stocks"), (yields, 0, "not real-yields evidence"), (None, -1, ""),
    )
    sector = (F.when(sector[0] < 0, whole[0]).otherwise(sector[0]), F.when(sector[0] < 0, whole[1]).otherwise(sector[1]))
    in_scope = F.when(scope == "macro", macro).when(scope == "sec_filings", sec).when(scope == "company_ir", company).otherwise(True)
    other = (in_scope.cast("int"), F.lit("generic source-scope match"))
    on_series = intent.startswith("macro_") | qid.startswith("web_10y") | qid.startswith("web_wti")
    by_intent = (("company_filings", filings), ("company_events", events), ("company_risk", risk), ("company_fundamentals", fundamentals), ("company_macro", exposure), ("portfolio_sector", sector), ("portfolio_macro", whole))
    grade, reason = F.when(on_series, series[0]).otherwise(other[0]), F.when(on_series, series[1]).otherwise(other[1])
    for name, (g, r) in reversed(by_intent):
        grade, reason = F.when(intent == name, g).otherwise(grade), F.when(intent == name, r).otherwise(reason)
    note, before = F.concat(F.lit("assistant_review_v1: "), reason), F.trim(F.coalesce("reviewer_notes", F.lit("")))
    label = F.trim(F.coalesce(F.col("human_relevance").cast("string"), F.lit("")))
    write = F.lit(overwrite) | (label == "")
    notes = note if overwrite else F.when(before == "", note).otherwise(F.concat_ws(" | ", before, note))
    return rows.withColumns({"human_relevance": F.when(write, grade.cast("string")).otherwise(F.col("human_relevance").cast("string")), "reviewer_notes": F.when(write, notes).otherwise(F.col("reviewer_notes"))})


def spotcheck_points(rank: Column, other: Column, ndcg: Column, near_human: Column, relevance: Column, source: Column, wrong: Column, mismatch: Column) -> tuple[Column, Column]:
    """Points for checking a judged result by hand, and their reasons; a null rank is a result that wasn't retrieved."""
    top, other_top, both = rank <= 10, other <= 10, rank.isNotNull() & other.isNotNull()
    delta = F.abs(other - rank)
    steps = (
        (top, 80 - rank, "primary_top10"), (other_top, 30 - F.least(other, F.lit(10)), "comparison_top10"), (both & (delta >= 5), F.least(F.lit(30), delta), "rank_disagreement"),
        (~both & (F.coalesce(top, F.lit(False)) | F.coalesce(other_top, F.lit(False))), F.lit(15), "new_top_result"), (ndcg < 0.85, F.lit(45), "weak_query"), ((ndcg >= 0.85) & (ndcg < 0.95), F.lit(25), "borderline_query"),
        (near_human, F.lit(25), "near_human_spotcheck_query"), (relevance.isin(1, 2), F.lit(18), "borderline_label"), ((source != "") & ~source.startswith("human_"), F.lit(10), "assistant_label"),
        (wrong, F.lit(30), "wrong_company_risk"), (mismatch, F.lit(18), "source_scope_mismatch"),
    )
    points = F.lit(0)
    for test, n, _ in steps:
        points = points + F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(why)) for t, _, why in steps])))
    return points, reasons


def spotcheck_queue(scored: DataFrame, per_query: int, limit: int) -> DataFrame:
    """The queue: at most `per_query` of a query, `limit` in all (its size), by points, query, rank and document."""
    order = [F.desc("priority"), F.asc("query_id"), F.asc(F.coalesce("rank_primary", F.lit(9999))), F.asc("doc_id")]
    own = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    kept = scored.filter("priority > 0").withColumn("own", own).filter(F.col("own") <= per_query).orderBy(*order).limit(limit)
    return kept.withColumn("spotcheck_id", F.format_string("spot_%04d", F.row_number().over(Window.orderBy(*order)))).drop("own")
