"""Text of filings from HTML, and the sections of a filing, as expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (form, item code, word of the title, section, title where the heading has none); 8-K items that aren't listed are current reports.
SECTIONS = (
    ("10-K", "1", "", "item_1_business", ""),
    ("10-K", "1A", "", "item_1a_risk_factors", "Risk Factors"),
    ("10-K", "7", "", "item_7_mda", "Management Discussion and Analysis"),
    ("10-K", "7A", "", "item_7a_market_risk", "Quantitative and Qualitative Disclosures About Market Risk"),
    ("10-K", "8", "", "item_8_financial_statements", "Financial Statements"),
    ("10-Q", "1", "financial", "part1_item_1_financial_statements", "Financial Statements"),
    ("10-Q", "2", "", "part1_item_2_mda", "Management Discussion and Analysis"),
    ("10-Q", "3", "", "part1_item_3_market_risk", "Quantitative and Qualitative Disclosures About Market Risk"),
    ("10-Q", "4", "", "part1_item_4_controls", ""),
    ("10-Q", "1", "legal", "part2_item_1_legal_proceedings", ""),
    ("10-Q", "1A", "", "part2_item_1a_risk_factors", "Risk Factors"),
    ("8-K", "1.01", "", "item_1_01_entry_into_material_definitive_agreement", ""),
    ("8-K", "1.02", "", "item_1_02_termination_of_material_definitive_agreement", ""),
    ("8-K", "2.01", "", "item_2_01_acquisition_or_disposition_of_assets", ""),
    ("8-K", "2.02", "", "item_2_02_results_operations_financial_condition", ""),
    ("8-K", "2.03", "", "item_2_03_direct_financial_obligation", ""),
    ("8-K", "2.05", "", "item_2_05_exit_or_disposal_activities", ""),
    ("8-K", "3.02", "", "item_3_02_unregistered_sales_of_equity", ""),
    ("8-K", "5.02", "", "item_5_02_director_or_officer_changes", ""),
    ("8-K", "5.03", "", "item_5_03_articles_bylaws_or_fiscal_year", ""),
    ("8-K", "5.07", "", "item_5_07_shareholder_vote", ""),
    ("8-K", "7.01", "", "item_7_01_regulation_fd_disclosure", ""),
    ("8-K", "8.01", "", "item_8_01_other_events", ""),
    ("8-K", "9.01", "", "item_9_01_financial_statements_exhibits", ""),
)
#: Fixed value: a line that begins an item, with the item's code and title.
HEADING = r"(?imd)^\s*(?:part\s+[ivx]+\s+)?item\s+([0-9]\.[0-9]{2}|[0-9]{1,2}[a-z]?)\s*[.\-:–—]?\s*([^\n]{0,180})$"
#: A character reference after its &.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _character(number: Column) -> Column:
    """The character of a code point; a replacement where there is none."""
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD)).cast("long")), 8, "0")), "UTF-32")


def unescape(text: Column) -> Column:
    """Character references, by name or number, as characters; what isn't one stays."""
    names = F.create_map(*[F.lit(x) for name, point in name2codepoint.items() for x in (name, chr(point))], F.lit("apos"), F.lit("'"))
    parts = F.split(F.coalesce(text, F.lit("")), "&", -1)

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        number = F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)
        char = F.when(name.startswith("#x") | name.startswith("#X"), _character(number.cast("long"))).when(name.startswith("#"), _character(F.substring(name, F.lit(2), F.length(name)).try_cast("long"))).otherwise(F.try_element_at(names, name))
        return F.when((name == "") | char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substring(part, F.length(name) + 2, F.length(part))))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(1), F.size(parts))), read), ""))


def html_lines(raw: Column) -> Column:
    """Lines of a page's text: scripts and tags dropped, a line for each block, white space squeezed, empty lines gone."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<(script|style|ix:header)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?is)<br\s*/?>|</(?:div|p|tr|td|th|table|section|article|h[1-6])>", "\n")
    text = unescape(F.regexp_replace(text, r"(?is)<[^>]+>", " "))
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{A0}]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _of(form: Column, code: Column, title: Column, what: int) -> Column:
    """The section (what 3) or the usual title (4) of an item of a form; null where the table has none."""
    key = F.concat_ws("|", form, code)
    plain = F.create_map(*[F.lit(x) for row in SECTIONS if not row[2] for x in (f"{row[0]}|{row[1]}", row[what])])
    out = F.try_element_at(plain, key)
    for row in reversed([r for r in SECTIONS if r[2]]):
        out = F.when((key == f"{row[0]}|{row[1]}") & F.contains(F.lower(title), F.lit(row[2])), row[what]).otherwise(out)
    return out


def sections(text: Column, form: Column, least: int = 250) -> Column:
    """The sections of a filing, in order of place: of each section's candidates the longest, the whole text where there is none.

    A candidate reaches from its heading to the next; one shorter than `least` is a line of the table of contents, but for 8-Ks. Headings
    and what stands between them come from one pattern, once as matches and once as what it splits, so places are sums of lengths.
    """
    text, form = F.coalesce(text, F.lit("")), F.upper(F.coalesce(form, F.lit("")))
    between = F.split(text, HEADING, -1)
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)(?<!\s)\s+$", "")
    # Step by step, so that no step works out what the one before it has.
    pieces = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(HEADING), F.lit(0)).alias("head"), between.alias("text")), lambda x: F.struct(x["head"].alias("head"), x["text"].alias("text")))
    read = F.transform(pieces, lambda x: F.struct(
        F.upper(F.regexp_replace(F.regexp_extract(x["head"], HEADING, 1), r"\s+", "")).alias("code"), F.regexp_extract(x["head"], HEADING, 2).alias("title"), F.length(x["text"]).alias("before"), F.length(x["head"]).alias("size"), trimmed(x["text"]).alias("body"),
    ))
    clean = F.transform(read, lambda x: F.struct(
        x["code"].alias("code"), F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x["title"], r"(?U)\s+", " "), r"^[ .:\-–—\t]+|[ .:\-–—\t]+$", ""), r"\s+\d+$", "")), 1, 160).alias("title"),
        x["before"].alias("before"), x["size"].alias("size"), x["body"].alias("body"),
    ))

    def named(x: Column) -> Column:
        current = F.when((form == "8-K") & x["code"].rlike(r"^\d\.\d{2}$"), F.concat(F.lit("item_"), F.replace(x["code"], F.lit("."), F.lit("_")), F.lit("_current_report")))
        usual = F.coalesce(F.nullif(_of(form, x["code"], x["title"], 4), F.lit("")), F.concat(F.when(form == "8-K", "8-K Item ").otherwise("Item "), x["code"]))
        return F.struct(F.coalesce(_of(form, x["code"], x["title"], 3), current, F.lit("")).alias("section_id"), F.when(x["title"] == "", usual).otherwise(x["title"]).alias("title"), x["code"].alias("code"), x["before"].alias("before"), x["size"].alias("size"), x["body"].alias("body"))

    found = "array<struct<section_id:string,by:int,start_char:int,item_code:string,title:string,body:string,end_char:int>>"
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("id"), F.lit("").alias("code"), F.lit("").alias("title"), F.lit(0).alias("begin"), F.array().cast(found).alias("found"))

    def step(s: Column, x: Column) -> Column:
        """What stands before a heading is the body of the heading before it."""
        head = F.concat(F.lit("Item "), s["code"], F.lit(". "), s["title"])
        whole = F.when(x["body"] == "", head).otherwise(F.concat(head, F.lit("\n"), x["body"]))
        one = F.struct(s["id"].alias("section_id"), F.lit(0).alias("by"), s["begin"].alias("start_char"), s["code"].alias("item_code"), s["title"].alias("title"), whole.alias("body"), (s["at"] + x["before"]).alias("end_char"))
        keep = (s["id"] != "") & ((F.length(x["body"]) >= least) | (form == "8-K"))
        at = s["at"] + x["before"]
        return F.struct((at + F.coalesce(x["size"], F.lit(0))).alias("at"), x["section_id"].alias("id"), x["code"].alias("code"), x["title"].alias("title"), at.alias("begin"), F.when(keep, F.concat(s["found"], F.array(one))).otherwise(s["found"]).alias("found"))

    candidates = F.aggregate(F.transform(clean, named), start, step, lambda s: s["found"])
    sized = F.transform(candidates, lambda x: F.struct(x["section_id"].alias("section_id"), (-F.length(x["body"])).alias("by"), *[x[c].alias(c) for c in ("start_char", "item_code", "title", "body", "end_char")]))
    made = lambda x: F.struct(*[x[c].alias(c) for c in ("start_char", "section_id", "item_code", "title", "body", "end_char")])
    kind = "array<struct<start_char:int,section_id:string,item_code:string,title:string,body:string,end_char:int>>"
    rest = F.transform(F.array(trimmed(text)), lambda t: F.when(t != "", F.struct(F.lit(0).alias("start_char"), F.lit("full_filing").alias("section_id"), F.lit("FULL").alias("item_code"), F.lit("Full Filing Text").alias("title"), t.alias("body"), F.length(text).alias("end_char"))))
    # Sorted by section, longest first, the first of each section stays.
    first = lambda s, x: F.struct(x["section_id"].alias("last"), F.when(x["section_id"] != s["last"], F.concat(s["out"], F.array(made(x)))).otherwise(s["out"]).alias("out"))
    return F.aggregate(F.array_sort(sized), F.struct(F.lit("").alias("last"), F.array().cast(kind).alias("out")), first, lambda s: F.when(F.size(s["out"]) > 0, F.array_sort(s["out"])).otherwise(F.array_compact(rest)))


def explode_sections(filings: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """A row for each section of each filing."""
    rows = filings.withColumn("section", F.explode(sections(F.col(text), F.col(form)))).select(*[c for c in filings.columns if c != text], "section.*")
    return rows.select(*[c for c in filings.columns if c != text], "section_id", "item_code", "title", "body", "start_char", "end_char")
