"""Queries of search: what a query asks for, how results fit and fall into groups, and how they are labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import labelling as L
from tidemark.operators import search as S
from tidemark.plans.registry import query
from tidemark.plans.roles import JUDGMENTS, RUNS, corpus, judgments, runs, table

#: What is asked, under which titles results stand, and what else a pool of results holds; ids pick from each, in strides that mix them.
ASKED = (
    "AAPL 10-Q filing", "jpm  Risk factors and litigation", "should I buy oil stocks?", "Fed rates and TREASURY yield", "credit cycle of banks", "eps guidance after results of operations", "supply chain margin pressure", "", None,
    "consumer spending on reddit", "my portfolio exposure to CPI", "dividend buyback press release", "annual report of wti producers", "blog posts about housing", "what was the free cash flow", "card spending, payments demand",
    "legal proceedings 8-K", "volatility vix spread", "cloud revenue sales", "avoid downside", "how much debt", "energy demand", "investor day presentation", "nothing in particular",
)
TITLES = (
    "ACME 10-Q filing filed 2020-05-01 - Item 1A. Risk Factors", "Acme 10-K filing filed 2019-02-11 - Exhibit 99.1", "Q3 FY2020 results &amp; outlook", "Fourth quarter 2019 earnings release", "Item 7 A market risk", "Consumer credit & loans 2019",
    "10-year minus 2-year Treasury spread", "High yield credit spread (BofA)", "WTI crude oil, fiscal 2018", "", None, "Management’s discussion: MDA", "Item 2.02 Results of operations", "Item 9.01 financial statements and exhibits", "Privacy and education: impact accelerator",
    "Unemployment and labor demand", "Health records news app", "JPM legal proceedings update", "T5 litigation, lawsuit", "Inflation: consumer price index", "Card member spending, revenue", "Gross margin &lt;cost&gt; pressure", "Yield curve", "GS guidance",
)
KINDS = ("sec_filing_section", "sec_filing_exhibit", "official_macro_release", "company_press_release", "Company_IR_Archive", "market_news", "headline_feed", None)
TAGS = ("earnings_guidance", "company_risk", "signal_margin_pressure", "press_release", "earnings_release_candidate", "market_risk", "", "oil|energy", "official_macro", "sec_section")
SCOPES = ("sec_filings", "macro", "company_ir", "", "other")
INTENTS = ("company_filings", "company_events", "company_risk", "company_fundamentals", "company_macro", "portfolio_sector", "portfolio_macro", "macro_rates", "", None, "Company_Risk")
QIDS = ("web_banks_credit_cycle", "web_it_real_yields", "web_10y_2y_spread", "web_yield_curve", "web_vix", "web_high_yield_spread", "web_wti_oil", "web_unemployment", "web_inflation", "web_portfolio_rates", "web_consumer_demand", "web_earnings_risk", "other", "web_10y_x")
EXPECTED = ("JPM", "MARKET", "", "T5", "gs", None, "T7")
FOLDERS = ("sec_filings", "macro", "company_ir", "", "news")
PICKS = (("query", ASKED, 1), ("title", TITLES, 7), ("source_type", KINDS, 5), ("event_tags", TAGS, 3), ("source_scope", SCOPES, 11), ("intent", INTENTS, 1), ("query_id", QIDS, 13), ("expected_ticker", EXPECTED, 17), ("folder_key", FOLDERS, 2))


def lit(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _pick(values: tuple, stride: int) -> str:
    return f"[{', '.join(map(lit, values))}][CAST((doc_id // 7 + doc_id * {stride}) % {len(values)} AS INT) + 1]"


FOUND_SQL = "CASE doc_id % 6 WHEN 0 THEN ['JPM'] WHEN 1 THEN ['MARKET'] WHEN 2 THEN ['T' || doc_id % 29] WHEN 3 THEN CAST([] AS VARCHAR[]) WHEN 4 THEN ['GS', 'T5'] ELSE ['T7', 'MARKET'] END"
POOL = f"""pool AS (SELECT doc_id, substr(text, 1, 0) AS none, {', '.join(f'{_pick(v, s)} AS {n}' for n, v, s in PICKS)}, {FOUND_SQL} AS tickers, ['T' || doc_id % 11] AS holdings, lang AS risk_terms, regexp_replace(text, '\\s+', ' ', 'g') AS excerpt,
  CAST(doc_id % 50 + 1 AS INT) AS rank, (doc_id % 97) / 97.0 AS score, (doc_id % 10) / 10.0 AS signal_strength FROM documents)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of results: a row a document, its whole text as excerpt."""
    d = table(spark, sf_dir, "documents")
    pick = lambda values, s: F.element_at(F.array(*map(F.lit, values)), (F.expr(f"(doc_id div 7 + doc_id * {s}) % {len(values)}") + 1).cast("int"))
    n = F.col("doc_id") % 6
    t = F.concat(F.lit("T"), (F.col("doc_id") % 29).cast("string"))
    found = F.when(n == 0, F.array(F.lit("JPM"))).when(n == 1, F.array(F.lit("MARKET"))).when(n == 2, F.array(t)).when(n == 3, F.array().cast("array<string>")).when(n == 4, F.array(F.lit("GS"), F.lit("T5"))).otherwise(F.array(F.lit("T7"), F.lit("MARKET")))
    return d.select(
        "doc_id", *[pick(v, s).alias(name) for name, v, s in PICKS], found.alias("tickers"), F.array(F.concat(F.lit("T"), (F.col("doc_id") % 11).cast("string"))).alias("holdings"), F.col("lang").alias("risk_terms"),
        F.regexp_replace("text", r"\s+", " ").alias("excerpt"), (F.col("doc_id") % 50 + 1).cast("int").alias("rank"), ((F.col("doc_id") % 97) / 97.0).alias("score"), ((F.col("doc_id") % 10) / 10.0).alias("signal_strength"),
    )


def has(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(t)})" for t in terms) + ")"


Q = "trim(regexp_replace(lower(coalesce(query, '')), '\\s+', ' ', 'g'))"
ENTITY = "len(list_filter(tickers, lambda t: t <> 'MARKET')) > 0"


def joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


_STEPS = [("sec", S.SEC_TERMS, "sec_filings", "filings", "sec_filing_language"), ("ir", S.COMPANY_TERMS, "company_ir", "company_events", "company_ir_language"), ("mac", S.MACRO_TERMS, "official_macro", "macro_data", "macro_language"), ("num", S.NUMBER_TERMS, "structured_facts", "numeric_or_table_data", "structured_numeric_language"), ("news", S.NEWS_TERMS, "market_news", "market_news_and_sentiment", "news_or_sentiment_language"), ("fav", S.FAVOURITE_TERMS, "favorite_websites", "user_favorite_sources", "favorite_source_language"), ("outs", S.OUTSIDE_TERMS, "external_web", "external_or_untrusted_sources", "external_source_language")]
_ON = {"num": "(num OR regexp_matches(q, '\\d'))"}


def _listed(k: int, extra: str = "") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_ON.get(s[0], s[0])} THEN '{s[k]}' END" for s in _STEPS) + extra + "], lambda x: x IS NOT NULL)"


INTENT = f"""{POOL}, q AS (SELECT doc_id, {Q} AS q, {ENTITY} AS ent FROM pool), h AS (SELECT *, {', '.join(f'{has("q", s[1])} AS {s[0]}' for s in _STEPS)}, {has("q", S.PORTFOLIO_TERMS)} AS mine FROM q),
i AS (SELECT *, {_listed(2)} AS routes0, {_listed(3)} AS labels0, {_listed(4, ", CASE WHEN ent THEN 'dow30_entity_match' END, CASE WHEN mine THEN 'portfolio_context_language' END")} AS reasons,
  list_filter([{', '.join(f"CASE WHEN {has('q', t)} THEN '{n}' END" for n, t in S.FIELDS)}], lambda x: x IS NOT NULL) AS fields FROM h),
intents AS (SELECT *, CASE WHEN len(routes0) > 0 THEN routes0 WHEN ent THEN ['company_ir'] ELSE ['local_corpus'] END AS routes, CASE WHEN len(labels0) > 0 THEN labels0 WHEN ent THEN ['company_events'] ELSE ['general_financial_text'] END AS kb FROM i)"""


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pool(spark, sf_dir)
    return S.query_intent(rows, F.col("query"), F.size(F.filter("tickers", lambda t: t != "MARKET")) > 0)


@query("query_intents", f"""WITH {INTENT} SELECT doc_id, array_to_string(routes, '|') AS routes, array_to_string(kb, '|') AS kb_labels, array_to_string(fields, '|') AS field_labels, array_to_string(reasons, '|') AS reasons,
  CASE WHEN mine THEN 'portfolio_impact' WHEN sec AND num THEN 'filing_fact_lookup' WHEN sec THEN 'filing_search' WHEN num THEN 'structured_numeric_lookup' WHEN mac THEN 'macro_regime_lookup' WHEN news OR outs THEN 'news_sentiment_lookup' WHEN fav THEN 'favorite_source_lookup' WHEN ent THEN 'company_event_search' ELSE 'general_financial_search' END AS primary_intent,
  (num OR regexp_matches(q, '\\d')) AS numeric, (outs OR fav) AS outside, CASE WHEN q = '' THEN 0.0 ELSE round(least(0.95, 0.35 + 0.10 * (sec::INT + ir::INT + mac::INT + num::INT + news::INT + mine::INT + fav::INT + outs::INT + ent::INT) + 0.05 * least(len(fields), 3)), 3) END::DOUBLE AS confidence FROM intents""")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intents(spark, sf_dir).select("doc_id", *map(joined, ("routes", "kb_labels", "field_labels", "reasons")), "primary_intent", "numeric", "outside", "confidence")


@query("query_topics", f"""WITH {POOL}, q AS (SELECT doc_id, {Q} AS q FROM pool) SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {has('q', t)} THEN '{n}' END" for n, t in S.TOPICS)}], lambda x: x IS NOT NULL), '|') AS topics,
  CASE {' '.join(f"WHEN {has('q', t)} THEN '{n}'" for n, t in S.MODES)} ELSE '' END AS mode FROM q""")
def query_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.squeezed(F.col("query"))
    return pool(spark, sf_dir).select("doc_id", F.array_join(S.held(q, S.TOPICS), "|").alias("topics"), S.first_held(q, S.MODES).alias("mode"))


def _demand(folder: str) -> str:
    parts = []
    for number in dict.fromkeys(d[1] for d in S.DEMANDS if d[0] == folder):
        steps = "".join(f" WHEN {has('q', t)} AND CASE WHEN ent THEN {a} ELSE {b} END > 0 THEN CASE WHEN ent THEN {a} ELSE {b} END" for f, n, a, b, t in S.DEMANDS if (f, n) == (folder, number))
        parts.append(f"CASE{steps} ELSE 0 END")
    return " + ".join(parts)


WEIGHTS = f"""{INTENT}, w0 AS (SELECT doc_id, q, ent, routes, CASE WHEN list_contains(routes, 'sec_filings') THEN 3.0 ELSE 0 END + {_demand('sec_filings')} AS s, CASE WHEN list_contains(routes, 'official_macro') THEN 3.5 ELSE 0 END AS m0, CASE WHEN list_contains(routes, 'market_news') THEN 1.5 ELSE 0 END AS n FROM intents),
w1 AS (SELECT *, m0 + {_demand('macro')} AS m, CASE WHEN {has('q', S.COMPANY_DEMAND)} THEN 3.0 WHEN list_contains(routes, 'company_ir') OR (ent AND s = 0 AND m0 = 0 AND n = 0) THEN 0.75 ELSE 0 END + CASE WHEN ent AND {has('q', S.SPENDING_DEMAND)} THEN 2.5 ELSE 0 END AS c FROM w0),
weights AS (SELECT doc_id, q, CAST(CASE WHEN ent AND s > 0 THEN s + 1 ELSE s END AS DOUBLE) AS sec_filings, CAST(CASE WHEN ent AND c > 0 THEN c + 0.75 ELSE c END AS DOUBLE) AS company_ir, CAST(m AS DOUBLE) AS macro, CAST(n AS DOUBLE) AS news FROM w1)"""


def _weights() -> dict[str, Column]:
    return S.intent_weights(F.col("query"), F.col("routes"), F.size(F.filter("tickers", lambda t: t != "MARKET")) > 0)


@query("source_intent_weights", f"WITH {WEIGHTS} SELECT doc_id, sec_filings, company_ir, macro, news FROM weights")
def source_intent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intents(spark, sf_dir).select("doc_id", *[w.cast("double").alias(n) for n, w in _weights().items() if n != "other_sources"])


FOLDER = "CASE WHEN starts_with(k, 'sec_filing') THEN 'sec_filings' WHEN starts_with(k, 'official_macro') THEN 'macro' WHEN starts_with(k, 'company_') THEN 'company_ir' WHEN contains(k, 'news') OR contains(k, 'headline') THEN 'news' ELSE 'other_sources' END"


@query("source_intent_boost", f"""WITH {WEIGHTS}, k AS (SELECT doc_id, lower(coalesce(source_type, '')) AS k, lower(event_tags) AS e FROM pool), b AS (SELECT w.*, k, e, {FOLDER} AS folder, greatest(sec_filings, company_ir, macro, news, 0) AS most FROM weights w JOIN k USING (doc_id)),
o AS (SELECT *, CASE folder WHEN 'sec_filings' THEN sec_filings WHEN 'company_ir' THEN company_ir WHEN 'macro' THEN macro WHEN 'news' THEN news ELSE 0 END AS own0 FROM b),
p AS (SELECT *, CASE WHEN k = 'sec_filing_exhibit' AND company_ir > sec_filings AND {has('e', S.EXHIBIT_EVENTS)} THEN greatest(own0, company_ir - 0.5) ELSE own0 END AS own FROM o)
SELECT doc_id, folder, CASE WHEN q = '' OR most <= 0 THEN 0.0 ELSE round(CASE WHEN own <= 0 AND most >= 3 THEN own - least(1.0, most * 0.15) ELSE own END, 6) END AS boost FROM p""")
def source_intent_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = S.folder_of(F.col("source_type"))
    return _intents(spark, sf_dir).select("doc_id", folder.alias("folder"), S.intent_boost(F.col("query"), _weights(), folder, F.col("source_type"), F.array("event_tags")).alias("boost"))


FIELD_TEXT = "replace(lower(concat_ws(' ', coalesce(title, ''), coalesce(source_type, ''), event_tags)), '_', ' ')"
_CREDIT, _FINANCIAL = ("JPM", "GS"), ("JPM", "GS", "T7")


@query("field_alignment", f"""WITH {POOL}, a AS (SELECT doc_id, {Q} AS q, {FIELD_TEXT} AS f, lower(coalesce(source_type, '')) AS k, tickers FROM pool), t AS (SELECT *, {', '.join(f'{has("q", t)} AS {n}' for n, t in S.TOPICS)} FROM a)
SELECT doc_id, CAST(CASE WHEN NOT earnings_guidance THEN 0 WHEN {has('f', S.GUIDANCE_FORMS)} THEN 5 WHEN contains(f, 'earnings release candidate') THEN 3 WHEN starts_with(k, 'company_') AND contains(f, 'press release') THEN -2 ELSE 0 END
  + {' + '.join(f"CASE WHEN {n} AND {has('f', t)} THEN {p} ELSE 0 END" for n, t, p in S.FITTING)} - CASE WHEN company_risk AND {has('f', S.EARNINGS_FORMS)} AND NOT {has('f', S.RISK_FORMS)} THEN 7 ELSE 0 END
  - CASE WHEN consumer_demand AND starts_with(k, 'official_macro') AND contains(f, 'credit') AND NOT contains(f, 'consumer') THEN 3 ELSE 0 END
  + CASE WHEN NOT bank_credit THEN 0 WHEN list_has_any(tickers, {list(_CREDIT)!r}) THEN 5 WHEN len(tickers) > 0 AND NOT list_has_any(tickers, {list(_FINANCIAL)!r}) THEN -4 ELSE 0 END AS DOUBLE) AS alignment FROM t""")
def field_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.replace(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("source_type", F.lit("")), "event_tags")), F.lit("_"), F.lit(" "))
    score = S.field_alignment(F.col("query"), fields, F.col("source_type"), F.col("tickers"), F.array(*map(F.lit, _CREDIT)), F.array(*map(F.lit, _FINANCIAL)))
    return pool(spark, sf_dir).select("doc_id", score.cast("double").alias("alignment"))


def _title_sql(column: str) -> str:
    out = f"coalesce({column}, '')"
    for name, text in S.REFERENCES:
        out = f"replace({out}, {lit(name)}, {lit(text)})"
    out = f"lower({out})"
    for pattern, by in S.TITLE_REWRITES:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(by.replace('$', chr(92)))}, 'g')"
    return f"trim({out})"


KEYED = f"""{POOL}, g AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' || (doc_id // 8) || '__s' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id, lower(coalesce(source_type, '')) AS k, title, tickers, regexp_extract(coalesce(title, ''), '(?i)^(.+?\\b(?:10-K|10-Q|8-K)\\s+filing filed\\s+\\d{{4}}-\\d{{2}}-\\d{{2}})\\s+-\\s+(?:Item|Exhibit)\\b', 1) AS filed FROM pool),
s AS (SELECT *, CASE WHEN filed = '' THEN title ELSE filed END AS shown FROM g)"""


@query("group_keys", f"""WITH {KEYED} SELECT doc_id, {_title_sql('title')} AS group_title, 'g_' || substr(sha1(CASE WHEN starts_with(k, 'official_macro') THEN 'official_macro_snapshots'
  WHEN starts_with(k, 'sec_filing') THEN 'sec_filing|' || CASE WHEN contains(id, '__') THEN split_part(id, '__', 1) ELSE {_title_sql('shown')} END
  ELSE array_to_string(list_sort(list_filter(tickers, lambda t: t <> 'MARKET')), ',') || '|' || k || '|' || {_title_sql('title')} END), 1, 16) AS group_key FROM s""")
def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.when(F.col("doc_id") % 4 == 0, F.expr("concat('a', cast(doc_id div 8 as string), '__s', cast(doc_id as string))")).otherwise(F.col("doc_id").cast("string"))
    return pool(spark, sf_dir).select("doc_id", S.group_title(F.col("title")).alias("group_title"), S.group_key(doc, F.col("source_type"), F.col("title"), F.col("tickers")).alias("group_key"))


@query("compact_tags", f"""WITH {POOL}, c AS (SELECT doc_id, list_filter(list_transform(tickers, lambda t: upper(t)), lambda t: t NOT IN ('', 'MARKET')) AS own, list_transform(list_concat(['signal_energy', 'sec_section'], string_split(event_tags, '|')), lambda t: trim(replace(regexp_replace(t, '^signal_', ''), '_', ' '))) AS told FROM pool),
t AS (SELECT doc_id, own, list_filter(list_transform(told, lambda x: array_to_string(list_transform(string_split(x, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')), lambda x: x <> '' AND upper(x) <> 'MARKET' AND x NOT IN ('Filing', 'Sec Section', 'Sec Filing', 'Document')) AS told FROM c),
a AS (SELECT doc_id, list_concat(own, told) AS l FROM t) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], '|') AS tags FROM a""")
def compact_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = S.compact_tags(F.col("tickers"), F.array(F.lit("signal_energy"), F.lit("sec_section")), F.split("event_tags", r"\|"))
    return pool(spark, sf_dir).select("doc_id", F.array_join(tags, "|").alias("tags"))


_NAMED = "SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN 'the risk of ' || lower(n_name) WHEN 1 THEN 'n' || (item_id % 25) || ' filings & stocks' WHEN 2 THEN substr(n_name, 1, CAST(2 + item_id % 6 AS INT)) || ' report' WHEN 3 THEN n_name || ' event signals 10k' ELSE 'what is ' || text END AS query FROM benchmark JOIN nation ON n_nationkey = item_id % 25"
_WORDS = "list_filter(string_split(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND w NOT IN ({1}))"


def _words(column: str, plain: tuple[str, ...]) -> str:
    return _WORDS.format(column, ", ".join(map(lit, plain)))


@query("query_entities", f"""WITH n0 AS (SELECT 'N' || n_nationkey AS ticker, lower('N' || n_nationkey) AS low, {_words("n_name || ' Corp.'", S.PLAIN_WORDS + S.NAME_WORDS)} AS names FROM nation),
n AS (SELECT *, list_filter(list_distinct([low, array_to_string(names, ' '), array_to_string(names, ''), coalesce(names[1], ''), array_to_string(names[1:2], ' '), array_to_string(names[1:2], '')]), lambda a: a <> '') AS aliases FROM n0),
q0 AS ({_NAMED}), q1 AS (SELECT query_id, {_words('query', S.PLAIN_WORDS + S.QUERY_WORDS)} AS words FROM q0), q AS (SELECT *, array_to_string(words, ' ') AS phrase, array_to_string(words, '') AS compact FROM q1 WHERE len(words) > 0)
SELECT query_id, ticker FROM q, n WHERE len(list_filter(words, lambda w: starts_with(low, w) OR list_contains(names, w) OR (length(w) >= 3 AND len(list_filter(names, lambda m: starts_with(m, w))) > 0))) > 0
  OR len(list_filter(aliases, lambda a: (length(a) >= 2 AND a IN (phrase, compact)) OR (length(a) >= 3 AND (starts_with(a, phrase) OR starts_with(phrase, a) OR starts_with(a, compact) OR starts_with(compact, a))))) > 0""")
def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, name = F.col("item_id"), F.col("n_name")
    said = (
        F.when(i % 5 == 0, F.concat(F.lit("the risk of "), F.lower(name))).when(i % 5 == 1, F.concat(F.lit("n"), (i % 25).cast("string"), F.lit(" filings & stocks")))
        .when(i % 5 == 2, F.concat(F.substring(name, F.lit(1), (2 + i % 6).cast("int")), F.lit(" report"))).when(i % 5 == 3, F.concat(name, F.lit(" event signals 10k"))).otherwise(F.concat(F.lit("what is "), "text"))
    )
    nations = table(spark, sf_dir, "nation")
    queries = table(spark, sf_dir, "benchmark").join(nations, i % 25 == F.col("n_nationkey")).select(i.alias("query_id"), said.alias("query"))
    names = nations.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"), F.concat(name, F.lit(" Corp.")).alias("name"))
    return S.query_entities(queries, names)


_SECTION = "replace(replace(replace(lower(concat_ws(' ', coalesce(title, ''), coalesce(source_type, ''), event_tags, risk_terms, excerpt)), '_', ' '), '’', ''''), '`', '''')"
_TOPIC = dict(S.TOPICS)
_FEATURES = ("base_score", "signal", "rank_prior", "expected_ticker_match", "wrong_company", "source_scope_match", "sec_scope_match", "macro_scope_match", "company_ir_scope_match", "field_exact", "field_bad", *(n for n, _, _ in L.SECTIONS), "risk_query_earnings_release_bad", "nonfinancial_press_bad")


def _on(test: str) -> str:
    return f"CASE WHEN {test} THEN 1.0 ELSE 0.0 END"


def _wants(topics: tuple[str, ...]) -> str:
    return "(" + " OR ".join(topics) + ")"


_SECTION_SQL = {n: f"({_wants(topics)} AND {has('f', terms)})" for n, topics, terms in L.SECTIONS}
_RISKY, _RELEASE = _wants(L.SECTIONS[0][1]), has("f", L.SECTIONS[3][2])
_LENDER = f"list_has_any(tickers, {list(L.LENDERS)!r})"
SCOPED = "source_scope = 'sec_filings' AND (starts_with(k, 'sec_') OR folder_key = 'sec_filings') AS in_sec, source_scope = 'macro' AND starts_with(k, 'official_macro') AS in_macro, source_scope = 'company_ir' AND (starts_with(k, 'company_') OR folder_key = 'company_ir') AS in_ir, e <> '' AND e <> 'MARKET' AND len(tickers) > 0 AND NOT list_contains(tickers, e) AND NOT list_contains(tickers, 'MARKET') AS wrong"


@query("rerank_features", f"""WITH {POOL}, a AS (SELECT *, {Q} AS q, {_SECTION} AS f, lower(coalesce(source_type, '')) AS k, upper(coalesce(expected_ticker, '')) AS e FROM pool), t AS (SELECT *, {SCOPED}, {', '.join(f'{has("q", t)} AS {n}' for n, t in S.TOPICS)} FROM a)
SELECT doc_id, round(score, 6)::DOUBLE AS base_score, round(signal_strength, 6)::DOUBLE AS signal, round(1.0 / rank, 6)::DOUBLE AS rank_prior, {_on("e <> '' AND e <> 'MARKET' AND list_contains(tickers, e)")}::DOUBLE AS expected_ticker_match, {_on('wrong')}::DOUBLE AS wrong_company,
  {_on('in_sec OR in_macro OR in_ir')}::DOUBLE AS source_scope_match, {_on('in_sec')}::DOUBLE AS sec_scope_match, {_on('in_macro')}::DOUBLE AS macro_scope_match, {_on('in_ir')}::DOUBLE AS company_ir_scope_match,
  ({_on(f"earnings_guidance AND {has('f', S.GUIDANCE_FORMS)}")} + {' + '.join(_on(f"{n} AND {has('f', t)}") for n, t, _ in S.FITTING)} + {_on(f'bank_credit AND {_LENDER}')})::DOUBLE AS field_exact,
  ({_on(f"earnings_guidance AND NOT {has('f', S.GUIDANCE_FORMS)} AND starts_with(k, 'company_') AND contains(f, 'press release')")} + {_on(f"company_risk AND {has('f', S.EARNINGS_FORMS)} AND NOT {has('f', S.RISK_FORMS)}")} + {_on(f"bank_credit AND NOT {_LENDER} AND len(tickers) > 0 AND NOT list_contains(tickers, 'MARKET')")})::DOUBLE AS field_bad,
  {', '.join(f'{_on(sql)}::DOUBLE AS {n}' for n, sql in _SECTION_SQL.items())},
  {_on(f"{_RISKY} AND {_RELEASE} AND NOT ({has('f', L.SECTIONS[0][2])} OR {has('f', L.SECTIONS[1][2])} OR {has('f', L.SECTIONS[2][2])})")}::DOUBLE AS risk_query_earnings_release_bad,
  {_on(f"earnings_guidance AND starts_with(k, 'company_') AND {has('replace(lower(coalesce(title, chr(32))), chr(8217), chr(39))', L.UNRELATED)}")}::DOUBLE AS nonfinancial_press_bad FROM t""")
def rerank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.rerank_features(pool(spark, sf_dir))
    return out.select("doc_id", *[F.round(c, 6).cast("double").alias(c) if c in ("base_score", "signal", "rank_prior") else F.col(c).cast("double").alias(c) for c in _FEATURES])


MATCH = f"""{POOL}, a AS (SELECT *, lower(concat_ws(' ', coalesce(query, ''), coalesce(title, ''), '', '', coalesce(source_type, ''), event_tags, risk_terms, excerpt)) AS t, lower(coalesce(source_type, '')) AS k, upper(trim(coalesce(expected_ticker, ''))) AS e, lower(trim(coalesce(intent, ''))) AS it, list_concat(tickers, holdings) AS fnd FROM pool),
b AS (SELECT *, CASE WHEN folder_key <> '' THEN folder_key ELSE {FOLDER} END AS family FROM a),
matched AS (SELECT *, CASE source_scope WHEN 'sec_filings' THEN family = 'sec_filings' WHEN 'company_ir' THEN family = 'company_ir' OR (k = 'sec_filing_exhibit' AND {has('t', L.OWN_MATERIAL)}) WHEN 'macro' THEN family = 'macro' ELSE family IN ('sec_filings', 'company_ir', 'macro') END AS source_match,
  CASE WHEN e = '' THEN TRUE WHEN e = 'MARKET' THEN list_contains(fnd, 'MARKET') OR family = 'macro' ELSE list_contains(fnd, e) OR regexp_matches(upper(coalesce(title, '')), '(^|[^A-Z0-9])' || e || '($|[^A-Z0-9])') END AS entity_match,
  CASE {' '.join(f"WHEN it = '{n}' THEN family IN ({', '.join(map(lit, fam))}) AND {has('t', t)}" for n, fam, t in L.INTENT_RULES)} WHEN starts_with(it, 'macro_') THEN family = 'macro' AND {has('t', L.MACRO_HINTS)} WHEN it IN ('portfolio_macro', 'portfolio_sector') THEN family = 'macro' OR {has('t', L.MACRO_HINTS)} ELSE {has('t', L.SEC_HINTS + L.EVENT_HINTS + L.MACRO_HINTS + L.FUNDAMENTAL_HINTS)} END AS intent_match FROM b)"""


def _family(rows: DataFrame) -> DataFrame:
    none = F.lit("")
    return rows.withColumns({"family": F.when(F.col("folder_key") != "", F.col("folder_key")).otherwise(S.folder_of(F.col("source_type"))), "group_title": none, "folder_title": none})


@query("match_votes", f"""WITH {MATCH}, v AS (SELECT *, source_match::INT + entity_match::INT + intent_match::INT AS votes FROM matched) SELECT doc_id, source_match, entity_match, intent_match, CASE WHEN (e <> '' AND e <> 'MARKET' AND NOT entity_match) OR (source_scope <> '' AND NOT source_match) THEN least(votes, 1) ELSE votes END AS relevance FROM v""")
def match_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.grades(_family(pool(spark, sf_dir))).select("doc_id", "source_match", "entity_match", "intent_match", "relevance")


def _case(*steps: tuple[str, str]) -> str:
    *tests, (_, last) = steps
    return "CASE " + " ".join(f"WHEN {t} THEN {g}" for t, g in tests) + f" ELSE {last} END"


_SERIES = _case(("NOT mac", "0"), *[(f"query_id = '{n}' AND {has('t', t)}", "3") for n, t in L.MACRO_DIRECT], (f"query_id = 'web_inflation' AND {has('t', ('oil', 'wti', 'energy'))}", "2"), (f"query_id = 'web_unemployment' AND {has('t', ('demand', 'consumer', 'growth'))}", "2"), ("", "1"))
_WHOLE = _case(("NOT (mac OR sec OR ir)", "0"), (f"query_id = 'web_portfolio_rates' AND mac AND {has('t', L.RATE_WORDS)}", "3"), ("query_id = 'web_portfolio_rates'", "1"), (f"query_id = 'web_consumer_demand' AND {has('t', L.DEMAND_WORDS)}", "CASE WHEN mac THEN 3 ELSE 2 END"), ("query_id = 'web_consumer_demand'", "mac::INT"),
    (f"query_id = 'web_earnings_risk' AND {has('t', L.APPETITE_WORDS)}", "CASE WHEN mac THEN 3 ELSE 2 END"), ("query_id = 'web_earnings_risk'", "mac::INT"), ("NOT mac", "1"), ("", _SERIES))
_BANKS = f"list_has_any(tickers, {list(L.BANKS)!r})"
_SECTOR = _case((f"query_id = 'web_banks_credit_cycle' AND list_contains(tickers, 'JPM') AND {has('t', L.BANK_WORDS)}", "3"), (f"query_id = 'web_banks_credit_cycle' AND {_BANKS} AND {has('t', L.BANK_WORDS)}", "2"), ("query_id = 'web_banks_credit_cycle'", "0"), (f"query_id = 'web_it_real_yields' AND mac AND {has('t', L.RATE_WORDS)}", "3"), ("query_id = 'web_it_real_yields'", "CASE WHEN mac THEN 2 ELSE 0 END"), ("", _WHOLE))
_LABELS = {
    "company_filings": _case(("NOT asked", "0"), ("contains(q, '10-q') AND contains(form, '10-q')", "3"), (f"contains(q, '10-q') AND {has('form', ('10-k', '8-k'))}", "2"), ("contains(q, '10-q')", "1"), ("sec", "3"), ("ir", "1"), ("", "0")),
    "company_events": _case(("NOT asked", "0"), ("contains(q, '8-k') AND contains(t, '8-k')", "3"), ("contains(q, '8-k') AND sec", "2"), ("contains(q, '8-k')", "1"), (has("t", L.DIRECT_EVENT), "3"), (has("t", L.NEAR_EVENT), "2"), ("sec OR ir", "1"), ("", "0")),
    "company_risk": _case((f"NOT asked AND query_id = 'web_banks_credit_cycle' AND {_BANKS}", "2"), ("NOT asked", "0"), (has("t", L.DIRECT_RISK), "3"), (has("t", L.NEAR_RISK), "2"), ("sec OR ir", "1"), ("", "0")),
    "company_fundamentals": _case(("NOT asked", "0"), (has("t", L.DIRECT_FUNDAMENTAL), "3"), (has("t", L.NEAR_FUNDAMENTAL), "2"), ("sec OR ir", "1"), ("", "0")),
    "company_macro": _case((f"asked AND {has('t', L.TOPICAL)}", "3"), ("asked AND (sec OR ir)", "2"), (f"mac AND {has('t', L.TOPICAL)}", "2"), ("", "0")),
    "portfolio_sector": _SECTOR, "portfolio_macro": _WHOLE,
}


@query("reviewer_labels", f"""WITH {POOL}, a AS (SELECT *, lower(concat_ws(' ', coalesce(title, ''), event_tags, excerpt, coalesce(source_type, ''), folder_key)) AS t, lower(concat_ws(' ', coalesce(source_type, ''), folder_key, event_tags)) AS about, lower(concat_ws(' ', coalesce(source_type, ''), folder_key)) AS wh, lower(concat_ws(' ', coalesce(title, ''), event_tags)) AS form, lower(coalesce(query, '')) AS q, lower(coalesce(intent, '')) AS it, upper(coalesce(expected_ticker, '')) AS e FROM pool),
b AS (SELECT *, contains(about, 'macro') AS mac, contains(wh, 'sec_filing') AS sec, {has('about', ('company_', 'company ir', 'company official'))} AS ir FROM a), c AS (SELECT *, CASE WHEN e = 'MARKET' THEN list_contains(tickers, 'MARKET') OR mac ELSE list_contains(tickers, e) END AS asked FROM b)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '2' ELSE CAST({_case(*[(f"it = '{n}'", sql) for n, sql in _LABELS.items()], ("starts_with(it, 'macro_') OR starts_with(query_id, 'web_10y') OR starts_with(query_id, 'web_wti')", _SERIES), ("source_scope = 'macro'", "mac::INT"), ("source_scope = 'sec_filings'", "sec::INT"), ("source_scope = 'company_ir'", "ir::INT"), ("", "1"))} AS VARCHAR) END AS human_relevance FROM c""")
def reviewer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pool(spark, sf_dir).withColumns({"human_relevance": F.when(F.col("doc_id") % 9 == 0, "2").otherwise(" "), "reviewer_notes": F.lit(None).cast("string")})
    return L.reviewer_labels(rows).select("doc_id", "human_relevance")


@query("review_flags", f"""WITH {POOL}, a AS (SELECT *, lower(coalesce(source_type, '')) AS k, upper(coalesce(expected_ticker, '')) AS e FROM pool), s AS (SELECT *, {SCOPED} FROM a)
SELECT doc_id, wrong, source_scope IN ('sec_filings', 'macro', 'company_ir') AND NOT (in_sec OR in_macro OR in_ir) AS mismatch, (starts_with(risk_terms, 'human_') OR lang2 IN ('human', 'user_chat', 'reviewer_1')) AS reviewed FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'human' WHEN 1 THEN 'rules' WHEN 2 THEN 'reviewer_1' END AS lang2x, coalesce(lang2x, '') AS lang2 FROM s)""")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.col("doc_id") % 5 == 0, "human").when(F.col("doc_id") % 5 == 1, "rules").when(F.col("doc_id") % 5 == 2, "reviewer_1")
    c = F.col
    return pool(spark, sf_dir).select("doc_id", L.wrong_company(c("expected_ticker"), c("tickers")).alias("wrong"), L.scope_mismatch(c("source_scope"), c("source_type"), c("folder_key")).alias("mismatch"), L.human_reviewed(c("risk_terms"), who).alias("reviewed"))


SPOT = f"""{RUNS}, {JUDGMENTS}, p AS (SELECT query_id, doc_id, rank FROM runs WHERE method = 'm1' AND rank <= 40), o AS (SELECT query_id, doc_id, rank FROM runs WHERE method = 'm2' AND rank <= 40), u AS (SELECT query_id, doc_id, p.rank AS rank_primary, o.rank AS rank_comparison FROM p FULL JOIN o USING (query_id, doc_id)),
r AS (SELECT p.query_id, sum(CASE WHEN rank <= 10 THEN (2.0 ** coalesce(relevance, 0) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM p LEFT JOIN judgments USING (query_id, doc_id) GROUP BY ALL), i AS (SELECT query_id, sum((2.0 ** relevance - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM judgments) WHERE place <= 10 GROUP BY ALL),
n AS (SELECT query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 9) AS ndcg FROM r LEFT JOIN i USING (query_id)),
f AS (SELECT u.*, relevance, CASE WHEN relevance IS NULL THEN '' WHEN doc_id % 3 = 0 THEN 'human_x' ELSE 'rules' END AS src, query_id % 4 = 0 AS near, doc_id % 7 = 0 AS wrong, doc_id % 5 = 0 AS mis, coalesce(ndcg, 1.0) AS ndcg FROM u LEFT JOIN judgments USING (query_id, doc_id) LEFT JOIN n USING (query_id)),
z AS (SELECT *, CASE WHEN rank_primary <= 10 THEN 80 - rank_primary ELSE 0 END + CASE WHEN rank_comparison <= 10 THEN 30 - rank_comparison ELSE 0 END + CASE WHEN abs(rank_comparison - rank_primary) >= 5 THEN least(30, abs(rank_comparison - rank_primary)) ELSE 0 END
  + CASE WHEN (rank_primary IS NULL AND rank_comparison <= 10) OR (rank_comparison IS NULL AND rank_primary <= 10) THEN 15 ELSE 0 END + CASE WHEN ndcg < 0.85 THEN 45 WHEN ndcg < 0.95 THEN 25 ELSE 0 END + CASE WHEN near THEN 25 ELSE 0 END + CASE WHEN relevance IN (1, 2) THEN 18 ELSE 0 END + CASE WHEN src = 'rules' THEN 10 ELSE 0 END + CASE WHEN wrong THEN 30 ELSE 0 END + CASE WHEN mis THEN 18 ELSE 0 END AS priority FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, coalesce(rank_primary, 9999), doc_id) AS own FROM z WHERE priority > 0), queue AS (SELECT *, 'spot_' || lpad(CAST(row_number() OVER (ORDER BY priority DESC, query_id, coalesce(rank_primary, 9999), doc_id) AS VARCHAR), 4, '0') AS spotcheck_id FROM (SELECT * FROM k WHERE own <= 6 ORDER BY priority DESC, query_id, coalesce(rank_primary, 9999), doc_id LIMIT 60))"""


def _ndcg(run: DataFrame, qrels: DataFrame) -> DataFrame:
    from tidemark.operators import evaluation as E

    return E.metrics(run, qrels).select("query_id", F.round("ndcg", 9).alias("ndcg"))


def _spotcheck(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every, qrels = runs(spark, sf_dir).filter("rank <= 40"), judgments(spark, sf_dir)
    first, other = (every.filter(F.col("method") == m) for m in ("m1", "m2"))
    rows = first.select("query_id", "doc_id", F.col("rank").alias("rank_primary")).join(other.select("query_id", "doc_id", F.col("rank").alias("rank_comparison")), ["query_id", "doc_id"], "full")
    ndcg = _ndcg(first, qrels)
    rows = rows.join(qrels, ["query_id", "doc_id"], "left").join(ndcg, "query_id", "left")
    source = F.when(F.col("relevance").isNull(), "").when(F.col("doc_id") % 3 == 0, "human_x").otherwise("rules")
    points, reasons = L.spotcheck_points(F.col("rank_primary"), F.col("rank_comparison"), F.coalesce("ndcg", F.lit(1.0)), F.col("query_id") % 4 == 0, F.col("relevance"), source, F.col("doc_id") % 7 == 0, F.col("doc_id") % 5 == 0)
    return L.spotcheck_queue(rows.withColumns({"priority": points, "reasons": reasons}), 6, 60), ndcg


@query("spotcheck_queue", f"WITH {SPOT} SELECT spotcheck_id, query_id, doc_id, rank_primary, rank_comparison, CAST(rank_comparison - rank_primary AS INT) AS rank_delta, CAST(priority AS INT) AS priority FROM queue")
def spotcheck_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spotcheck(spark, sf_dir)[0].select("spotcheck_id", "query_id", "doc_id", "rank_primary", "rank_comparison", (F.col("rank_comparison") - F.col("rank_primary")).cast("int").alias("rank_delta"), F.col("priority").cast("int").alias("priority"))


@query("spotcheck_summary", f"WITH {SPOT} SELECT query_id, count(*) AS selected_rows, round(avg(priority), 3) AS mean_priority, round(coalesce(max(ndcg), 0), 6) AS weak_query_ndcg_at_10 FROM queue GROUP BY query_id")
def spotcheck_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ndcg = _spotcheck(spark, sf_dir)
    return rows.groupBy("query_id").agg(F.count("*").alias("selected_rows"), F.round(F.avg("priority"), 3).alias("mean_priority"), F.round(F.coalesce(F.max("ndcg"), F.lit(0.0)), 6).alias("weak_query_ndcg_at_10"))
