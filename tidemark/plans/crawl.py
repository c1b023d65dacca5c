"""Queries of crawled dates, exhibits, section tags and vendors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import crawl as C
from tidemark.plans.registry import query
from tidemark.plans.roles import CORPUS, corpus, table
from tidemark.plans.search import has, lit

_SAID = ("Published March 5, 2019 by us", "on Sept. 31 2020 nothing", "dec 1 2021", "may 09, 2014 and June 3, 2015", "no date here", "Jan. 3, 1999", "AUGUST 17 2022.", None)
_PATHS = ("/2019/03/05/a", "/news/2020-11-30/", "/x-02-28-2018-y", "/2021/13/01/", "/2020/02/31/x", "/archive/2017/", "/none?d=/2019/01/01/", "/2016/1/9")
_TIMES = ("Tue, 05 Mar 2019 14:30:00 GMT", "5 Mar 2019 14:30:00 +0200", "2019-03-05T14:30:00Z", "2019-03-05T14:30:00+05:30", "2019-03-05 14:30:00", "2019-03-05", "3/5/2019 14:30:00", "03/05/2019 02:30:00 PM", "3/5/2019", "yesterday", "", "2019-02-31T00:00:00Z")
_FILES = (
    "ex99-1.htm", "a_ex991.htm", "dex101.htm", "exhibit3_2.html", "xyz-ex10.12.htm", "form10k.htm", "report.xml", "0001-19-000001.txt", "acme-index.html", "exh21.txt", "d99.htm", "ex-99.HTM", "sub/ex31.1.htm", "notes.htm", "ex1234.htm", "", "ex2.jpg",
)
_SECTIONS = ("exhibit_99_1", "exhibit_10_2", "exhibit_3_1", "item_1a_risk_factors", "part1_item_2_mda", "item_8_financial_statements", "item_7a_market_risk", "full_filing", "item_2_02_results_operations_financial_condition", "other")
_FORMS = ("10-K", "10-Q", "8-K", "8-k")
_SITES = ("https://x.q4cdn.com/a", "https://ir.example/default.aspx", "https://a.gcs-web.com", "https://b.example/quotemedia", "https://c.example/wp-content/x", "https://d.example", "https://e.example/recaptcha", "https://f.example/just a moment")
_STATUS = (200, 403, 404, 429, None, 500, 301)


def _at(values: tuple, key: str, stride: int = 1):  # noqa: ANN202
    return F.element_at(F.array(*map(F.lit, values)), ((F.col(key) * stride + F.floor(F.col(key) / 11)) % len(values) + 1).cast("int"))


def _sql(values: tuple, key: str, stride: int = 1) -> str:
    return f"[{', '.join('NULL' if v is None else str(v) if isinstance(v, int) else lit(v) for v in values)}][CAST(({key} * {stride} + {key} // 11) % {len(values)} AS INT) + 1]"


_MONTH = "list_position([" + ", ".join(map(repr, C.THREE)) + "], lower(substr({0}, 1, 3)))"
_PATH = r"regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _found(p: str, order: tuple[int, int, int]) -> str:
    y, m, d = (f"regexp_extract(path, '{p}', {g})" for g in order)
    return f"CAST(try_strptime({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d') AS DATE)"


DATED = f"""s AS (SELECT page_id, {_sql(_SAID, 'page_id')} AS said, 'https://h.example' || {_sql(_PATHS, 'page_id', 3)} AS u FROM pages), p AS (SELECT *, {_PATH} AS path, regexp_extract(coalesce(said, ''), '{C.MONTH_DATE}', ['m', 'd', 'y']) AS md FROM s),
dated AS (SELECT *, CASE WHEN md.m <> '' THEN CAST(try_strptime(md.y || '-' || lpad(CAST({_MONTH.format('md.m')} AS VARCHAR), 2, '0') || '-' || lpad(md.d, 2, '0'), '%Y-%m-%d') AS DATE) END AS month_date,
  CASE {' '.join(f"WHEN regexp_matches(path, '{x}') THEN {_found(x, (1, 2, 3) if k < 2 else (3, 1, 2))}" for k, x in enumerate(C.PATH_DATES))} END AS path_date FROM p)"""


@query("page_dates", f"WITH {DATED} SELECT page_id, CAST(month_date AS VARCHAR) AS month_date, CAST(path_date AS VARCHAR) AS path_date, coalesce(CAST(path_date AS VARCHAR) || 'T23:59:59Z', CAST(month_date AS VARCHAR) || 'T23:59:59Z', CASE WHEN regexp_matches(u, '20[0-2][0-9]') THEN regexp_extract(u, '20[0-2][0-9]') || '-12-31T23:59:59Z' END, 'none') AS available_at FROM dated")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, said = F.concat(F.lit("https://h.example"), _at(_PATHS, "page_id", 3)), _at(_SAID, "page_id")
    return table(spark, sf_dir, "pages").select("page_id", C.month_date(said).cast("string").alias("month_date"), C.path_date(url).cast("string").alias("path_date"), C.candidate_available_at(url, said, F.lit("none")).alias("available_at"))


_UTC = ("2019-03-05T14:30:00Z", "2019-03-05T12:30:00Z", "2019-03-05T14:30:00Z", "2019-03-05T09:00:00Z", "2019-03-05T14:30:00Z", "2019-03-05T00:00:00Z", "2019-03-05T14:30:00Z", "2019-03-05T14:30:00Z", "2019-03-05T00:00:00Z", None, None, None)


@query("parsed_times", f"SELECT event_id, {_sql(_UTC, 'event_id')} AS utc, CASE WHEN event_id % 3 = 0 THEN strftime(TIMESTAMP '2020-01-01' + to_hours(CAST(event_id % 5000 AS INT)), '%Y-%m-%dT%H:%M:%SZ') ELSE CAST(DATE '2020-01-01' + CAST(event_id % 900 AS INT) AS VARCHAR) || 'T16:00:00Z' END AS accepted FROM events")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format(F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(event_id % 5000 as int))"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, ".125").otherwise(""))).otherwise(_at(_TIMES, "event_id"))
    said = F.when((F.col("event_id") % 3 != 0) & said.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), "").otherwise(said)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("event_id") % 900).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", C.utc_text(_at(_TIMES, "event_id")).alias("utc"), C.accepted_at(said, day).alias("accepted"))


_NAME = "regexp_replace(lower(regexp_extract(name, '([^/]*)$', 1)), '(.)\\.[^.]*$', '\\1')"
FILES = f"""f AS (SELECT event_id, event_id // 9 AS filing, {_sql(_FILES, 'event_id')} AS name FROM events), g AS (SELECT *, {_NAME} AS stem, lower(trim(name)) AS low FROM f), h AS (SELECT *, regexp_replace(stem, '[^a-z0-9]', '', 'g') AS compact FROM g),
i AS (SELECT *, regexp_extract(stem, '{C.EXHIBIT_PAIR}', ['a', 'b']) AS x, regexp_extract(compact, '{C.EXHIBIT_JOINED}', ['a', 'b']) AS y, regexp_extract(compact, '{C.EXHIBIT_ONE}', 1) AS one FROM h),
j AS (SELECT *, CASE WHEN x.a <> '' THEN x.a ELSE y.a END AS a, CASE WHEN x.a <> '' THEN x.b ELSE y.b END AS b FROM i),
named AS (SELECT *, CASE WHEN b <> '' THEN CASE WHEN length(a) = 3 AND a[1:2] IN ('99', '10') THEN 'exhibit_' || a[1:2] || '_' || CAST(a[3:3] AS INT) ELSE 'exhibit_' || CAST(a AS INT) || '_' || CAST(b AS INT) END
  WHEN one <> '' THEN CASE WHEN length(one) >= 3 AND one[1:2] IN ('99', '10') THEN 'exhibit_' || one[1:2] || '_' || CAST(one[3:] AS INT) ELSE 'exhibit_' || CAST(one AS INT) END ELSE 'exhibit_attachment_' || CASE WHEN compact = '' THEN 'unknown' ELSE substr(compact, 1, 50) END END AS exhibit_id FROM j)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 9).alias("filing"), _at(_FILES, "event_id").alias("name"), F.lit(" FORM10K.htm").alias("primary"))


@query("exhibit_ids", f"WITH {FILES} SELECT event_id, exhibit_id FROM named")
def exhibit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("event_id", C.exhibit_id(F.col("name")).alias("exhibit_id"))


@query("filing_exhibits", rf"""WITH {FILES}, k AS (SELECT *, CASE WHEN starts_with(exhibit_id, 'exhibit_99') THEN 0 WHEN starts_with(exhibit_id, 'exhibit_10') THEN 1 WHEN starts_with(exhibit_id, 'exhibit_3') THEN 2 ELSE 5 END AS prio FROM named
  WHERE low <> '' AND low <> 'form10k.htm' AND regexp_matches(low, '\.(htm|html|txt)$') AND NOT contains(low, '-index') AND NOT (ends_with(low, '.txt') AND length(low) - length(replace(low, '-', '')) >= 2) AND (regexp_matches(stem, '{C.EXHIBIT_NAME}') OR regexp_matches(compact, '{C.EXHIBIT_COMPACT}'))),
r AS (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY prio, exhibit_id, lower(name), name) AS place FROM k) SELECT filing, name, exhibit_id, place FROM r WHERE place <= 3""")
def filing_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exhibits(_files(spark, sf_dir).dropDuplicates(["filing", "name"]), 3).select("filing", "name", "exhibit_id", "place")


def _tag(words: str, names: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(s, '{words}') THEN '{n}' END" for n in names)


_RANKED = " ".join(f"WHEN upper(f) = '{form}' AND s = '{s}' THEN {r}" for form, order in C.SECTION_ORDER.items() for s, r in order)


@query("section_rules", f"""WITH a AS (SELECT event_id, {_sql(_SECTIONS, 'event_id')} AS s, {_sql(_FORMS, 'event_id', 3)} AS f, CASE WHEN event_id % 5 = 0 THEN 'sec_filing_exhibit' ELSE 'sec_filing_section' END AS k FROM events),
b AS (SELECT *, list_filter(['filing', 'sec_section', lower(f), {', '.join(_tag(w, n) for w, n in C.SECTION_TAGS)}, CASE WHEN f = '8-K' THEN 'current_report' END], lambda x: x IS NOT NULL) AS t FROM a)
SELECT event_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS tags, CASE WHEN upper(f) = '8-K' AND starts_with(s, 'exhibit_99') THEN 0 WHEN upper(f) = '8-K' AND starts_with(s, 'exhibit_10') THEN 4 WHEN upper(f) = '8-K' AND k = 'sec_filing_exhibit' THEN 8 {_RANKED} ELSE 8 END AS section_rank FROM b""")
def section_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", _at(_SECTIONS, "event_id").alias("s"), _at(_FORMS, "event_id", 3).alias("f"), F.when(F.col("event_id") % 5 == 0, "sec_filing_exhibit").otherwise("sec_filing_section").alias("k"))
    return e.select("event_id", F.array_join(C.section_tags(F.col("s"), F.col("f")), "|").alias("tags"), C.section_rank(F.col("f"), F.col("s"), F.col("k")).alias("section_rank"))


@query("vendor_profiles", f"""WITH a AS (SELECT page_id, lower({_sql(_SITES, 'page_id')} || ' ' || html) AS t, {_sql(_STATUS, 'page_id', 3)} AS st FROM pages), v AS (SELECT page_id, CASE WHEN st IN (403, 429) AND {has('t', C.CHALLENGE)} THEN 'cloudflare_challenge' {' '.join(f"WHEN {has('t', w)} THEN '{n}'" for n, w in C.VENDORS)} WHEN st IS NULL OR st >= 400 THEN 'fetch_problem' ELSE 'static_html_or_custom' END AS vendor FROM a)
SELECT page_id, vendor, CASE WHEN page_id % 6 = 0 THEN 'low_already_has_generic_yield' {' '.join(f"WHEN vendor IN ({', '.join(map(lit, w))}) THEN '{n}'" for n, w in C.VENDOR_PRIORITY)} ELSE 'medium_source_specific_adapter' END AS priority FROM v""")
def vendor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", C.vendor(_at(_SITES, "page_id"), F.col("html"), _at(_STATUS, "page_id", 3)).alias("vendor"))
    return p.withColumn("priority", C.vendor_priority(F.col("vendor"), (F.col("page_id") % 6 == 0).cast("int")))


@query("fallback_releases", f"""WITH {CORPUS}, a AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'news' ELSE 'sec_filing_exhibit' END AS k, CASE doc_id % 4 WHEN 0 THEN 'Exhibit 99.1' WHEN 1 THEN 'Investor Presentation' WHEN 2 THEN 'Notes' ELSE 'quarterly RESULTS' END AS title, len(regexp_extract_all(body, '\\S+')) AS n FROM corpus)
SELECT 'company_t3_sec_exhibit_fallback_' || right(CAST(doc_id AS VARCHAR), 16) AS doc_id, n AS body_word_count, array_to_string([event_tags[1], 'company_official', 'sec_exhibit_fallback'], '|') AS event_tags FROM a
WHERE k = 'sec_filing_exhibit' AND list_contains(tickers, 'T3') AND year(available_at) BETWEEN 2020 AND 2021 AND {has("lower(title || ' ' || substr(body, 1, 1000))", C.GOOD_EXHIBIT)} AND n >= 120""")
def fallback_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 4
    d = corpus(spark, sf_dir).withColumns({"kind": F.when(F.col("doc_id") % 3 == 0, "news").otherwise("sec_filing_exhibit"), "title": F.when(n == 0, "Exhibit 99.1").when(n == 1, "Investor Presentation").when(n == 2, "Notes").otherwise("quarterly RESULTS")})
    good = d.filter(C.good_exhibit(F.col("kind"), F.col("tickers"), "T3", F.col("available_at").cast("string"), 2020, 2021, F.col("title"), F.col("body")))
    return C.as_release(good, "T3").select("doc_id", F.col("body_word_count").cast("long").alias("body_word_count"), F.array_join("event_tags", "|").alias("event_tags"))
