"""Rule-based features of documents, rules for macro observations, and daily aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import count_terms, safe_double

#: The word lists; words count as beginnings of words, phrases as they are.
LEXICONS: dict[str, tuple[str, ...]] = {
    "positive": ("accelerat", "beat", "benefit", "better than expected", "buyback", "cash return", "confidence", "expand", "favorable", "growth", "improve", "increase", "margin expansion", "outperform", "raise", "record", "recover", "resilient", "strong", "tailwind", "upgrade"),
    "negative": ("bankruptcy", "challenge", "constrain", "decline", "delay", "downgrade", "fall", "headwind", "impairment", "investigation", "lawsuit", "lower", "miss", "pressure", "recession", "reduce", "slow", "soft", "uncertain", "weak"),
    "uncertainty": ("could", "estimate", "expect", "may", "might", "outlook", "possible", "risk", "uncertain", "volatil", "would"),
    "forward_looking": ("anticipate", "expect", "forecast", "guidance", "next quarter", "outlook", "project", "will"),
    "rates": ("fed", "federal reserve", "interest rate", "real yield", "treasury", "yield curve"),
    "inflation": ("cpi", "consumer price", "inflation", "price pressure", "ppi"),
    "credit": ("bank lending", "credit", "default", "funding cost", "high yield", "loan demand", "spread"),
    "labor_growth": ("employment", "growth", "industrial production", "jobs", "payroll", "unemployment"),
    "market_volatility": ("risk appetite", "selloff", "vix", "volatil"),
    "energy": ("brent", "crude", "energy", "oil", "wti"),
    "housing": ("construction", "home", "housing", "mortgage", "real estate"),
    "legal_regulatory": ("antitrust", "compliance", "investigation", "lawsuit", "legal", "litigation", "regulation", "regulatory", "sanction"),
    "supply_chain": ("backlog", "component shortage", "inventory", "logistics", "shortage", "supply chain"),
    "consumer_demand": ("consumer", "demand", "retail", "spending", "traffic"),
    "margin_pressure": ("cost pressure", "gross margin", "input cost", "margin pressure", "operating margin", "wage pressure"),
    "capital_return": ("buyback", "cash return", "dividend", "repurchase", "shareholder return"),
    "mna": ("acquisition", "divestiture", "merger", "spin-off", "takeover"),
}
#: The signals, by whether they count as macro or company ones; an intent or tag that sets a signal without a word.
MACRO_SIGNALS = {"macro_rates": ("rates", "rates_policy"), "inflation": ("inflation", "inflation_pressure"), "credit": ("credit", "credit_stress"), "labor_growth": ("labor_growth", "macro_growth"), "market_volatility": ("market_volatility", "market_volatility"), "energy": ("energy", None), "housing": ("housing", None)}
COMPANY_SIGNALS = {"legal_regulatory": ("legal_regulatory", "legal_regulatory"), "supply_chain": ("supply_chain", None), "consumer_demand": ("consumer_demand", None), "margin_pressure": ("margin_pressure", None), "capital_return": ("capital_return", None), "mna": ("mna", None)}
SIGNALS = ("earnings_guidance", "company_risk", "macro_rates", "inflation", "credit", "labor_growth", "market_volatility", "energy", "housing", "legal_regulatory", "supply_chain", "consumer_demand", "margin_pressure", "capital_return", "mna")


def capped(count: Column, whole: float) -> Column:
    return F.round(F.least(F.lit(1.0), count / max(whole, 1)), 6)


def direction(sentiment: Column, risk: Column) -> Column:
    return F.when((sentiment >= 0.18) & (risk < 0.35), "positive").when((sentiment <= -0.18) | (risk >= 0.65), "negative").when((F.abs(sentiment) < 0.08) & (risk < 0.30), "neutral").otherwise("mixed")


def document_features(rows: DataFrame) -> DataFrame:
    """Adds counts, intensities, signals, relevance and direction.

    rows has title, body, event_tags, risk_terms (arrays), intent, source_type, severity and macro_relevance; nulls count as empty.
    """
    lists = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")), lists("event_tags"), lists("risk_terms"), F.coalesce("intent", F.lit(""))))
    rows = rows.withColumn("text_", text)
    rows = rows.withColumns({f"n_{k}": count_terms(F.col("text_"), v) for k, v in LEXICONS.items()})
    n = lambda k: F.col(f"n_{k}")
    tag = lambda t: F.coalesce(F.array_contains(F.transform("event_tags", F.lower), t), F.lit(False))
    intent = F.lower(F.coalesce("intent", F.lit("")))
    risks = F.coalesce(F.size(F.array_distinct(F.transform("risk_terms", F.lower))), F.lit(0))
    signals = {
        "earnings_guidance": intent.contains("earnings_guidance") | tag("earnings_release_candidate") | tag("guidance") | F.col("text_").contains("exhibit_99"),
        "company_risk": intent.contains("company_risk") | tag("risk_factors"),
    } | {k: (n(words) > 0) | (intent == F.lit(said) if said else F.lit(False)) for k, (words, said) in (MACRO_SIGNALS | COMPANY_SIGNALS).items()}
    rows = rows.withColumns({f"signal_{k}": v.cast("int") for k, v in signals.items()})
    total = lambda names: sum((F.col(f"signal_{k}") for k in names), F.lit(0))
    words = F.greatest(F.lit(1), F.regexp_count("text_", F.lit("[a-zA-Z][a-zA-Z\\-']+")))
    numbers = F.regexp_count("text_", F.lit(r"\b\d+(?:\.\d+)?%?\b"))
    company = [k for k in SIGNALS if k not in MACRO_SIGNALS]
    relevance = 0.20 + 0.12 * total(MACRO_SIGNALS) + 0.10 * total(company) + 0.15 * safe_double("severity") + 0.10 * safe_double("macro_relevance")
    relevance = relevance + 0.10 * F.coalesce(F.lower("source_type").isin("sec_filing_exhibit", "official_macro_release").cast("int"), F.lit(0))
    rows = rows.withColumns(
        {
            "token_count": words, "numeric_count": numbers,
            "sentiment_proxy": F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n("positive") - n("negative")) / F.greatest(n("positive") + n("negative"), F.lit(3)))), 6),
            "risk_intensity": capped(n("negative") + n("uncertainty") + risks + tag("risk_factors").cast("int") + intent.contains("legal_regulatory").cast("int"), 10),
            "opportunity_intensity": capped(n("positive") + n("capital_return"), 8),
            "uncertainty_intensity": capped(n("uncertainty"), 8),
            "forward_looking_intensity": capped(n("forward_looking") + intent.contains("guidance").cast("int"), 7),
            "numerical_density": F.round(F.least(F.lit(1.0), numbers / F.greatest(words / 100.0, F.lit(1.0)) / 12.0), 6),
            "action_relevance": F.round(F.least(F.lit(1.0), relevance), 6),
        }
    )
    return rows.withColumn("impact_direction", direction(F.col("sentiment_proxy"), F.col("risk_intensity"))).drop("text_", *[f"n_{k}" for k in LEXICONS if k not in ("positive", "negative")])


#: Fixed values: (series, test, bound, direction, risk, uncertainty, sentiment, opportunity, relevance, signals); the first row of a
#: series whose test holds is its rule, "" holds always.
MACRO_RULES = (
    (("T10Y2Y",), "<", -0.25, "negative", 0.85, 0.35, -0.65, 0.0, 0.85, ("macro_rates", "credit")),
    (("T10Y2Y",), "<", 0.25, "mixed", 0.55, 0.35, -0.20, 0.1, 0.75, ("macro_rates", "credit")),
    (("T10Y2Y",), ">=", 1.0, "positive", 0.20, 0.20, 0.35, 0.35, 0.75, ("macro_rates", "credit")),
    (("T10Y2Y",), "", None, "neutral", 0.35, 0.25, 0.05, 0.15, 0.65, ("macro_rates", "credit")),
    (("DGS10", "DGS2", "FEDFUNDS"), ">=", 4.5, "negative", 0.75, 0.30, -0.55, 0.0, 0.85, ("macro_rates", "credit")),
    (("DGS10", "DGS2", "FEDFUNDS"), ">=", 3.0, "mixed", 0.50, 0.25, -0.20, 0.10, 0.75, ("macro_rates", "credit")),
    (("DGS10", "DGS2", "FEDFUNDS"), "<=", 0.5, "mixed", 0.35, 0.30, 0.10, 0.25, 0.65, ("macro_rates", "credit")),
    (("DGS10", "DGS2", "FEDFUNDS"), "", None, "neutral", 0.30, 0.20, 0.05, 0.15, 0.65, ("macro_rates",)),
    (("VIXCLS",), ">=", 30, "negative", 0.85, 0.55, -0.75, 0.0, 0.90, ("market_volatility",)),
    (("VIXCLS",), ">=", 20, "mixed", 0.55, 0.35, -0.25, 0.05, 0.75, ("market_volatility",)),
    (("VIXCLS",), "<=", 15, "positive", 0.20, 0.15, 0.35, 0.25, 0.65, ("market_volatility",)),
    (("VIXCLS",), "", None, "neutral", 0.35, 0.25, 0.0, 0.1, 0.65, ("market_volatility",)),
    (("BAMLH0A0HYM2",), ">=", 6, "negative", 0.85, 0.45, -0.70, 0.0, 0.90, ("credit",)),
    (("BAMLH0A0HYM2",), ">=", 4, "mixed", 0.60, 0.35, -0.30, 0.05, 0.80, ("credit",)),
    (("BAMLH0A0HYM2",), "", None, "positive", 0.25, 0.20, 0.30, 0.25, 0.70, ("credit",)),
    (("DCOILWTICO",), ">=", 100, "mixed", 0.60, 0.35, -0.15, 0.20, 0.80, ("energy", "inflation", "margin_pressure")),
    (("DCOILWTICO",), "<=", 40, "mixed", 0.55, 0.35, -0.20, 0.10, 0.75, ("energy", "labor_growth")),
    (("DCOILWTICO",), "", None, "neutral", 0.35, 0.25, 0.0, 0.15, 0.65, ("energy", "inflation")),
    (("CPIAUCSL",), "", None, "neutral", 0.35, 0.25, 0.0, 0.0, 0.70, ("inflation", "margin_pressure")),
    (("UNRATE",), ">=", 7, "negative", 0.80, 0.35, -0.65, 0.0, 0.85, ("labor_growth", "consumer_demand")),
    (("UNRATE",), "<=", 4, "positive", 0.25, 0.20, 0.35, 0.30, 0.70, ("labor_growth", "consumer_demand", "margin_pressure")),
    (("UNRATE",), "", None, "neutral", 0.35, 0.25, 0.0, 0.15, 0.65, ("labor_growth", "consumer_demand")),
    (("HOUST",), "<=", 900, "negative", 0.65, 0.35, -0.45, 0.0, 0.75, ("housing", "labor_growth")),
    (("HOUST",), ">=", 1500, "positive", 0.30, 0.25, 0.30, 0.30, 0.70, ("housing", "labor_growth")),
    (("HOUST",), "", None, "neutral", 0.35, 0.25, 0.0, 0.15, 0.65, ("housing",)),
    (("PAYEMS", "INDPRO"), "", None, "neutral", 0.30, 0.25, 0.0, 0.15, 0.65, ("labor_growth", "consumer_demand")),
)
NO_VALUE = ("neutral", 0.2, 0.3, 0.0, 0.0, 0.45, ("macro_rates",))
NO_RULE = ("neutral", 0.30, 0.25, 0.0, 0.10, 0.60, ("macro_rates",))


def macro_series(explicit: Column, text: Column, doc_id: Column) -> Column:
    """The series of an observation: named, else in the text, else in the document's id."""
    named = F.upper(F.trim(F.coalesce(explicit, F.lit(""))))
    said = F.upper(F.regexp_extract(text, r"\bSeries\s+([A-Z0-9]+)\s*:", 1))
    by_id = F.upper(F.regexp_extract(F.lower(doc_id), r"official_macro_([a-z0-9]+)_\d{4}-\d{2}-\d{2}", 1))
    return F.when(named != "", named).when(said != "", said).otherwise(by_id)


def macro_value(explicit: Column, text: Column) -> Column:
    found = F.regexp_extract(text, r"\bValue:\s*([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.coalesce(explicit.try_cast("double"), found)


def macro_rules(series: Column, value: Column) -> Column:
    """A struct of what the rule table says for a series and a value."""

    def made(row: tuple) -> Column:
        names = ("impact_direction", "risk_intensity", "uncertainty_intensity", "sentiment_proxy", "opportunity_intensity", "action_relevance", "signals")
        return F.struct(*[F.lit(" ".join(v) if isinstance(v, tuple) else v if isinstance(v, str) else float(v)).alias(k) for k, v in zip(names, row, strict=True)])

    out = F.when((series == "") | series.isNull() | value.isNull(), made(NO_VALUE))
    for names, test, bound, *row in MACRO_RULES:
        holds = {"<": value < F.lit(bound), ">=": value >= F.lit(bound), "<=": value <= F.lit(bound)}.get(test, F.lit(True)) if test else F.lit(True)
        out = out.when(series.isin(*names) & holds, made(tuple(row)))
    return out.otherwise(made(NO_RULE))


def weighted_mean(value: Column, final: Column, decay: Column) -> Column:
    """Mean by rank score and freshness, both with a floor; 0 without rows."""
    w = F.greatest(safe_double(final), F.lit(0.05)) * F.greatest(safe_double(decay), F.lit(0.01))
    return F.round(F.coalesce(F.sum(safe_double(value) * w) / F.sum(w), F.lit(0.0)), 6)


def daily_features(rows: DataFrame, keys: list[str], prefix: str, means: dict[str, str], signals: list[str]) -> DataFrame:
    """Aggregates of document features for each day (and ticker): counts, weighted means, the worst severity, signal counts and flags."""
    mean = lambda c: weighted_mean(F.col(c), F.col("final_score"), F.col("decay_weight_30d"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias(f"{prefix}_doc_count"), F.count_distinct("doc_id").alias(f"{prefix}_unique_doc_count"),
        *[mean(c).alias(f"{prefix}_{name}") for c, name in means.items()], F.round(F.max(safe_double("severity")), 6).alias(f"{prefix}_max_severity"),
        *[F.sum(s).cast("long").alias(f"{prefix}_{s}_count") for s in signals], *[F.max((F.col(s) > 0).cast("int")).alias(f"{prefix}_{s}_flag") for s in signals],
    )


def retrieval_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, best score, mean of the best five, and mean product of score and credibility."""
    best = F.slice(F.sort_array(F.collect_list("final_score"), asc=False), 1, 5)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.max("final_score"), 6).alias("top1"),
        F.round(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(best), F.lit(1)), 12).alias("top5_mean"),
        F.count_if(F.col("severity") >= 0.5).alias("severe"), F.round(F.avg(F.col("final_score") * F.col("credibility")), 12).alias("credible_score"),
    )


def by_ticker(rows: DataFrame, tickers: str = "tickers") -> DataFrame:
    """A row for each ticker of a row; those without one count for the market."""
    return rows.withColumn("tic", F.explode(F.when(F.size(tickers) > 0, F.col(tickers)).otherwise(F.array(F.lit("MARKET")))))
