"""Ordered keyword and threshold rules, as tables that compile into expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (words, result); the first row any of whose words stands in the text holds.
DOCUMENT_TYPES = (
    (("presentation", "event"), "company_presentation"), (("annual", "report", "proxy"), "company_financial_report"), (("sec", "filing"), "company_sec_filing_hub"),
    (("earning", "financial", "quarter"), "company_earnings_release"), (("press", "news"), "company_press_release"), (("investor",), "company_ir_archive"),
)
INTENTS = (
    (("inflation", "consumer_prices"), "inflation_pressure"), (("rates", "yield", "monetary_policy"), "rates_policy"), (("credit", "spread"), "credit_stress"), (("volatility", "risk_appetite"), "market_volatility"),
    (("labor", "growth", "housing"), "macro_growth"), (("risk_factors",), "company_risk"), (("earnings", "guidance", "exhibit_99"), "earnings_guidance"), (("legal", "regulation", "litigation"), "legal_regulatory"),
)
ORIENTATIONS = (
    (("current ratio", "cur_ratio"), "low_bad"), (("revenue", "eps", "margin", "sentiment", "revision", "upside", "growth", "liquidity"), "low_bad"),
    (("risk", "warning", "stress", "debt", "credit", "legal", "regulatory", "pressure", "spread", "yield level", "vix", "vol", "inversion", "cost"), "high_bad"),
)
#: Every row whose words stand in the text adds its tag.
EVENT_TAGS = (
    (("earnings", "quarter", "financial results", "results"), "earnings_release_candidate"), (("guidance", "outlook", "forecast"), "guidance"), (("dividend", "share repurchase", "buyback"), "capital_return"),
    (("acquisition", "merger", "divestiture", "spin-off", "spinoff"), "mna"), (("lawsuit", "litigation", "regulatory", "investigation"), "legal_regulatory"),
)
RISK_TERMS = ("inflation", "interest rates", "supply chain", "litigation", "regulation", "recession", "credit", "demand", "margin", "foreign exchange", "oil", "commodity")
#: Fixed values: (measure, points, test, bound) of each card in order; the first row of a measure that holds gives its points, "else" always.
CARDS = {
    "rates": (
        ("real_10y_yield", -0.45, ">", 1.75), ("real_10y_yield", 0.25, "<", 0.75), ("real_10y_yield", -0.10, "else", 0), ("investment_grade_credit_spread", -0.35, ">", 1.65),
        ("investment_grade_credit_spread", 0.20, "<", 1.10), ("fed_funds_rate", -0.15, ">", 5.0), ("fed_funds_rate", 0.10, "<", 3.5),
    ),
    "growth": (
        ("payrolls_3m_avg", 0.30, ">=", 175000), ("payrolls_3m_avg", -0.30, "<", 75000), ("payrolls_3m_avg", 0.05, "else", 0), ("unemployment_3m_change", -0.35, ">=", 0.35), ("unemployment_3m_change", 0.20, "<=", 0.05),
        ("unemployment_3m_change", -0.05, "else", 0), ("retail_sales_yoy", 0.25, ">", 2.0), ("retail_sales_yoy", -0.25, "<", 0.0), ("ism_new_orders", 0.20, ">=", 52.0), ("ism_new_orders", -0.20, "<", 48.0),
    ),
    "earnings": (
        ("sp500_earnings_revision_3m", 0.35, ">", 0.02), ("sp500_earnings_revision_3m", -0.35, "<", -0.02), ("dxy_yoy", -0.20, ">", 5.0), ("dxy_yoy", 0.10, "<", -3.0), ("vix", -0.30, ">", 25.0), ("vix", 0.20, "<", 16.0),
        ("wti_yoy", -0.10, ">", 35.0), ("wti_yoy", 0.05, "within", 20.0),
    ),
}


def first_rule(text: Column, rules: tuple[tuple[tuple[str, ...], str], ...], default: str | Column) -> Column:
    lowered, out = F.lower(F.coalesce(text, F.lit(""))), None
    for words, result in rules:
        test = F.lit(False)
        for w in words:
            test = test | lowered.contains(w)
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(default)


def all_rules(text: Column, rules: tuple[tuple[tuple[str, ...], str], ...], *always: str) -> Column:
    """Sorted tags of every rule that holds, and those that are always given."""
    tags = [first_rule(text, (r,), F.lit(None).cast("string")) for r in rules]
    return F.array_sort(F.array_compact(F.array(*[F.lit(a) for a in always], *tags)))


def risk_terms(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, RISK_TERMS)), lambda t: F.contains(lowered, t))


def source_family(kind: Column, source: Column, url: Column) -> Column:
    k, s, u = (F.lower(F.coalesce(c, F.lit(""))) for c in (kind, source, url))
    return (
        F.when(k.startswith("official_macro") | u.contains("fred.stlouisfed.org"), "official_macro").when(k.startswith("sec_filing") | u.contains("sec.gov") | s.contains("edgar"), "sec_edgar")
        .when(k.startswith("company_"), "company_ir").when(k == "sample", "sample").otherwise("other")
    )


def entity_alignment(found: Column, wanted: Column, kind: Column, macro_first: Column) -> Column:
    """6 for a wanted entity; else 0 or -7 for a macro release, -10 for another company, -4 for none."""
    both = F.size(F.array_intersect(found, wanted)) > 0
    company = F.size(F.filter(found, lambda t: (t != "") & (t != "MARKET"))) > 0
    macro = F.when(macro_first, 0.0).otherwise(-7.0)
    return F.when(F.size(wanted) == 0, 0.0).when(both, 6.0).when(F.lower(kind).startswith("official_macro"), macro).when(company, -10.0).otherwise(-4.0)


def severity(tags: Column, kind: Column) -> Column:
    has = lambda *names: F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, names)))
    return (
        F.when(has("risk_factors", "credit_stress"), 0.90).when(has("earnings_release_candidate", "guidance"), 0.80).when(has("official_macro", "inflation_pressure", "rates_policy"), 0.75)
        .when(F.lower(kind) == "sec_filing_exhibit", 0.70).when(has("current_report"), 0.65).otherwise(0.40)
    )


def macro_relevance(tags: Column, tickers: Column, kind: Column) -> Column:
    whole = kind.startswith("official_macro") | F.array_contains(F.transform(tickers, F.lower), "market")
    some = F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, ("inflation", "rates_policy", "credit_stress", "market_volatility", "macro_growth", "yield_curve"))))
    return F.when(whole, 1.0).when(some, 0.75).otherwise(0.20)


def intent(text: Column, layer: Column) -> Column:
    return first_rule(text, INTENTS, F.when(layer == "portfolio", "macro_growth").otherwise("company_risk"))


def card_score(name: str) -> Column:
    """Sum of the points of a card's measures; a missing measure gives none."""
    total = F.lit(0.0)
    for measure in dict.fromkeys(r[0] for r in CARDS[name]):
        c, out = F.col(measure), F.when(F.col(measure).isNull(), 0.0)
        for _, points, test, bound in (r for r in CARDS[name] if r[0] == measure):
            holds = {">": c > bound, ">=": c >= bound, "<": c < bound, "<=": c <= bound, "within": F.abs(c) < bound, "else": F.lit(True)}[test]
            out = out.when(holds, points)
        total = total + out.otherwise(0.0)
    return total


def upside(f: dict[str, Column]) -> Column:
    plus = lambda c: F.greatest(F.lit(0.0), c)
    return plus(f["sentiment"]) + f["opportunity"] + 0.5 * f["forward"] + 0.6 * f["earnings_guidance"] + 0.4 * f["capital_return"] + plus(f["impact"])


def risk_alert(f: dict[str, Column]) -> Column:
    minus = lambda c: F.greatest(F.lit(0.0), -c)
    return f["risk"] + f["uncertainty"] + minus(f["sentiment"]) + 0.5 * f["company_risk"] + 0.5 * f["legal_regulatory"] + 0.4 * f["margin_pressure"] + 0.3 * f["supply_chain"] + minus(f["impact"])


def calibrated(strength: Column, usefulness: Column) -> Column:
    return strength * (1 + F.least(F.lit(0.35), 4 * usefulness))


def search_total(f: dict[str, Column], mode: str, has_company: Column, is_macro: Column) -> Column:
    """Final score of a search result; mode is "opportunity", "risk" or none."""
    bonus = F.lit(0.0)
    if mode == "opportunity":
        bonus = F.when(has_company, 2.0).otherwise(-1.25) - F.when(is_macro, 1.25).otherwise(0.0)
    elif mode == "risk":
        bonus = F.when(has_company, 0.75).otherwise(0.0)
    by_mode = {"opportunity": f["upside"], "risk": f["risk_alert"]}.get(mode, F.lit(0.0))
    return f["lexical"] + 1.15 * f["signal"] + 0.75 * by_mode + 0.35 * f["event"] + 0.30 * f["credibility"] + 2.50 * f["usefulness"] + bonus + f["source"] + f["entity"] + f["field"]
