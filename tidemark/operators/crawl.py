"""Dates that pages, feeds and filings give, exhibits of a filing, section tags and priorities, and what a site runs on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.search import has_any

#: Month names as pages write them, by their first three letters.
MONTHS = ("jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august", "sep", "sept", "september", "oct", "october", "nov", "november", "dec", "december")
THREE = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_DATE = r"(?i)\b(" + "|".join(MONTHS) + r")\.?\s+([0-3]?\d),?\s+(20[0-2][0-9])\b"
#: Dates in a URL's path, year first in the first two.
PATH_DATES = (
    r"/(20[0-2][0-9])/(0?[1-9]|1[0-2])/(0?[1-9]|[12]\d|3[01])(?:/|$|-)",
    r"/(20[0-2][0-9])-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])(?:/|$|-)",
    r"[-_/](0?[1-9]|1[0-2])[-_/](0?[1-9]|[12]\d|3[01])[-_/](20[0-2][0-9])(?:/|$|-)",
)
#: File names that are no exhibits, and the words of a name that is one.
NO_TEXT = (".xml", ".xsd", ".jpg", ".jpeg", ".png", ".gif", ".zip", ".css", ".js")
EXHIBIT_NAME, EXHIBIT_COMPACT = r"(^|[-_])ex(?:hibit|h)?[-_.]?\d", r"ex(?:99|10|3|\d)|dex\d|exhibit\d|exh\d"
EXHIBIT_PAIR, EXHIBIT_JOINED, EXHIBIT_ONE = r"(?:exhibit|exh|ex|dex)[-_]?(\d{1,3})[-_.](\d{1,3})", r"(?:exhibit|exh|ex|dex)(99|10|3)(\d{1,3})", r"(?:exhibit|exh|ex|dex)(\d{1,3})"
#: Tags of a section by words of its id, after those of its form.
SECTION_TAGS = (
    ("^exhibit_", ("sec_exhibit", "exhibit")), ("^exhibit_99", ("earnings_release_candidate", "investor_material")), ("^exhibit_10", ("material_agreement",)), ("^exhibit_3", ("governance",)),
    ("risk_factors", ("risk_factors",)), ("mda", ("mda", "management_discussion")), ("financial_statements", ("financial_statements",)), ("market_risk", ("market_risk",)),
)
#: Fixed values: (vendor, words of a page's address or text); the first that holds.
VENDORS = (
    ("q4_or_q4_like", ("q4api", "q4apikey", "q4cdn.com", "q4app.com", "/default.aspx")), ("gcs_web", ("gcs-web.com",)), ("quotemedia", ("quotemedia",)), ("wordpress", ("wp-json", "/wp-content/")),
    ("captcha_module", ("recaptcha", "hcaptchasitekey")),
)
CHALLENGE = ("cloudflare", "just a moment", "cf-mitigated")
VENDOR_PRIORITY = (
    ("high_vendor_api_adapter", ("q4_or_q4_like", "gcs_web", "quotemedia")), ("medium_browser_or_alternate_endpoint", ("cloudflare_challenge", "captcha_module")), ("medium_wp_rest_or_sitemap", ("wordpress",)),
    ("medium_recheck_or_replace", ("fetch_problem",)),
)
#: Which section of a filing speaks for it, smallest first.
SECTION_ORDER = {
    "10-Q": (("part1_item_2_mda", 1), ("part2_item_1a_risk_factors", 2), ("part1_item_1_financial_statements", 3), ("part1_item_3_market_risk", 4), ("part2_item_1_legal_proceedings", 5), ("part1_item_4_controls", 6), ("full_filing", 9)),
    "8-K": (
        ("item_2_02_results_operations_financial_condition", 2), ("item_8_01_other_events", 3), ("item_1_01_entry_into_material_definitive_agreement", 4), ("item_5_02_director_or_officer_changes", 5),
        ("item_7_01_regulation_fd_disclosure", 6), ("item_9_01_financial_statements_exhibits", 7), ("full_filing", 9),
    ),
}
GOOD_EXHIBIT = ("exhibit 99.1", "exhibit_99_1", "earnings", "investor", "presentation", "results")


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def month_date(text: Column) -> Column:
    """The first date with a month's name in a text."""
    text = F.coalesce(text, F.lit(""))
    month = F.array_position(F.array(*map(F.lit, THREE)), F.lower(F.substring(F.regexp_extract(text, MONTH_DATE, 1), 1, 3)))
    return F.when(month > 0, _day(F.regexp_extract(text, MONTH_DATE, 3), month.cast("string"), F.regexp_extract(text, MONTH_DATE, 2)))


def path_date(url: Column) -> Column:
    """The date in a URL's path, by the first pattern that is found."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    out = F.lit(None).cast("date")
    for k, pattern in reversed(list(enumerate(PATH_DATES))):
        part = [F.regexp_extract(path, pattern, g) for g in (1, 2, 3)]
        found = _day(*part) if k < 2 else _day(part[2], part[0], part[1])
        out = F.when(F.regexp_like(path, F.lit(pattern)), found).otherwise(out)
    return out


def end_of_day(day: Column) -> Column:
    """A date alone counts from its last second."""
    return F.concat(day.cast("string"), F.lit("T23:59:59Z"))


def candidate_available_at(url: Column, text: Column, fallback: Column) -> Column:
    """From the URL's date, a date in the text's first 500 characters, the last day of a year in the URL, or the fallback."""
    year = F.regexp_extract(F.coalesce(url, F.lit("")), "20[0-2][0-9]", 0)
    return F.coalesce(end_of_day(path_date(url)), end_of_day(month_date(F.substring(text, 1, 500))), F.when(year != "", F.concat(year, F.lit("-12-31T23:59:59Z"))), fallback)


def utc_text(value: Column) -> Column:
    """Mail dates, ISO times and American dates as ISO text in UTC; no zone counts as UTC, null where none fits."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UT|UTC)$", " +0000")
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00+00:00"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("+00:00"))))
    american = lambda form: F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(form + " Z"))
    at = F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), zoned.try_cast("timestamp"), american("M/d/yyyy HH:mm:ss"), american("M/d/yyyy hh:mm:ss a"), american("M/d/yyyy"))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def accepted_at(value: Column, day: Column) -> Column:
    """A filing's time of acceptance, or four o'clock of its day."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.concat(F.substring(text, 1, 19), F.lit("Z"))).otherwise(F.concat(day.cast("string"), F.lit("T16:00:00Z")))


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(name, r"([^/]*)$", 1)), r"(?<=.)\.[^.]*$", "")


def _number(text: Column) -> Column:
    return text.cast("int").cast("string")


def exhibit_id(name: Column) -> Column:
    """exhibit_<number>_<part> from a file's name, or its letters where there is no number."""
    stem = _stem(name)
    compact = F.regexp_replace(stem, "[^a-z0-9]", "")
    part = lambda pattern, g, text: F.nullif(F.regexp_extract(text, pattern, g), F.lit(""))
    first = F.coalesce(part(EXHIBIT_PAIR, 1, stem), part(EXHIBIT_JOINED, 1, compact))
    second = F.when(part(EXHIBIT_PAIR, 1, stem).isNotNull(), part(EXHIBIT_PAIR, 2, stem)).otherwise(part(EXHIBIT_JOINED, 2, compact))
    alone, glued = part(EXHIBIT_ONE, 1, compact), (F.length(first) == 3) & first.rlike("^(99|10)")
    two = F.when(glued, F.concat(F.lit("exhibit_"), F.substring(first, 1, 2), F.lit("_"), _number(F.substring(first, 3, 1)))).otherwise(F.concat(F.lit("exhibit_"), _number(first), F.lit("_"), _number(second)))
    one = F.when((F.length(alone) >= 3) & alone.rlike("^(99|10)"), F.concat(F.lit("exhibit_"), F.substring(alone, 1, 2), F.lit("_"), _number(F.substring(alone, 3, 3)))).otherwise(F.concat(F.lit("exhibit_"), _number(alone)))
    rest = F.concat(F.lit("exhibit_attachment_"), F.when(compact == "", "unknown").otherwise(F.substring(compact, 1, 50)))
    return F.when(second.isNotNull(), two).when(alone.isNotNull(), one).otherwise(rest)


def is_exhibit_file(name: Column, primary: Column) -> Column:
    """Whether a file of a filing is an exhibit's text: not the filing itself, an index, a picture or the whole submission."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    kind = low.rlike(r"\.(htm|html|txt)$") & ~F.contains(low, F.lit("-index")) & ~(low.endswith(".txt") & (F.length(low) - F.length(F.replace(low, F.lit("-"), F.lit(""))) >= 2))
    stem = _stem(low)
    return (low != "") & (low != F.lower(F.trim(primary))) & kind & (stem.rlike(EXHIBIT_NAME) | F.regexp_replace(stem, "[^a-z0-9]", "").rlike(EXHIBIT_COMPACT))


def exhibits(files: DataFrame, most: int) -> DataFrame:
    """The first `most` exhibits of each filing (filing, name, primary), press releases first."""
    found = files.filter(is_exhibit_file(F.col("name"), F.col("primary"))).withColumn("exhibit_id", exhibit_id(F.col("name")))
    rank = F.when(F.col("exhibit_id").startswith("exhibit_99"), 0).when(F.col("exhibit_id").startswith("exhibit_10"), 1).when(F.col("exhibit_id").startswith("exhibit_3"), 2).otherwise(5)
    place = F.row_number().over(Window.partitionBy("filing").orderBy(rank, "exhibit_id", F.lower("name"), "name"))
    return found.withColumn("place", place).filter(F.col("place") <= most)


def section_tags(section_id: Column, form: Column) -> Column:
    tags = [F.lit("filing"), F.lit("sec_section"), F.lower(form)]
    for words, names in SECTION_TAGS:
        tags += [F.when(section_id.rlike(words), n) for n in names]
    return F.array_distinct(F.array_compact(F.array(*tags, F.when(form == "8-K", "current_report"))))


def section_rank(form: Column, section_id: Column, kind: Column) -> Column:
    """How well a section speaks for its filing; less is better."""
    form, out = F.upper(form), F.lit(8)
    for name, order in SECTION_ORDER.items():
        for section, rank in order:
            out = F.when((form == name) & (section_id == section), rank).otherwise(out)
    current = form == "8-K"
    return F.when(current & section_id.startswith("exhibit_99"), 0).when(current & section_id.startswith("exhibit_10"), 4).when(current & (kind == "sec_filing_exhibit"), 8).otherwise(out)


def vendor(url: Column, page: Column, status: Column) -> Column:
    text = F.lower(F.concat_ws(" ", url, page))
    out = F.when(status.isNull() | (status >= 400), "fetch_problem").otherwise("static_html_or_custom")
    for name, words in reversed(VENDORS):
        out = F.when(has_any(text, words), name).otherwise(out)
    return F.when(status.isin(403, 429) & has_any(text, CHALLENGE), "cloudflare_challenge").otherwise(out)


def vendor_priority(name: Column, accepted: Column) -> Column:
    out = F.lit("medium_source_specific_adapter")
    for priority, vendors in reversed(VENDOR_PRIORITY):
        out = F.when(name.isin(*vendors), priority).otherwise(out)
    return F.when(accepted > 0, "low_already_has_generic_yield").otherwise(out)


def good_exhibit(kind: Column, tickers: Column, ticker: str, at: Column, first_year: int, last_year: int, title: Column, body: Column) -> Column:
    """Whether an exhibit can stand in for a company's own release: its ticker, its years, its words, 120 words at least."""
    year = F.substring(F.coalesce(at, F.lit("")), 1, 4).try_cast("int")
    text = F.lower(F.concat_ws(" ", title, F.substring(F.coalesce(body, F.lit("")), 1, 1000)))
    return (kind == "sec_filing_exhibit") & F.array_contains(F.transform(tickers, F.upper), ticker) & F.coalesce(year.between(first_year, last_year), F.lit(False)) & has_any(text, GOOD_EXHIBIT) & (F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"\S+")) >= 120)


def as_release(rows: DataFrame, ticker: str) -> DataFrame:
    """Exhibits as a company's earnings releases, with where they come from."""
    low = ticker.lower()
    return rows.withColumns({
        "doc_id": F.concat(F.lit(f"company_{low}_sec_exhibit_fallback_"), F.when(F.length(F.col("doc_id").cast("string")) > 16, F.expr("right(cast(doc_id as string), 16)")).otherwise(F.col("doc_id").cast("string"))),
        "source": F.lit(f"company_official_{low}_sec_exhibit_fallback"), "source_type": F.lit("company_earnings_release"), "source_credibility": F.lit(0.9), "fetch_status": F.lit("ok"), "fallback_source_type": F.lit("sec_filing_exhibit"),
        "body_word_count": F.regexp_count(F.coalesce("body", F.lit("")), F.lit(r"\S+")), "event_tags": F.array_distinct(F.concat("event_tags", F.array(F.lit("company_official"), F.lit("sec_exhibit_fallback")))),
    })
