"""Cases that the tables don't hold: nulls, ties, empty inputs, greedy selection."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import times as S
from tidemark.operators import evaluation, linking, panel, queues, retrieval, selection, stats


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_text(spark):
    r = one(
        spark, tokens=X.tokens(F.lit("BRK.B's $5.20 don't .x")), none=X.tokens(F.lit(None).cast("string")), cut=X.excerpt(F.lit("a  b\nc d"), 6),
        bad=X.safe_double(F.lit("nan"), 3.0), inf=X.safe_double(F.lit("inf")), number=X.number_of(F.lit("($1,234.50)")), slug=X.slug("event", F.lit("Risk-off / Sale")), listed=X.list_of(F.lit(" a | ;b;")),
    )
    assert r.tokens == ["brk.b's", "5.20", "don't", "x"] and r.none == [] and r.cut == "a b..."
    assert (r.bad, r.inf, r.number, r.slug, r.listed) == (3.0, 0.0, -1234.5, "event_risk_off_sale", ["a", "b"])


def test_chart_numbers(spark):
    held = [142.35, 142.25, 0.35, 2.5, -0.04, -0.0, 5e-05, 1.005, 2.0**53 + 2, 141718415116019.6, 1e23, 1e300, float("inf"), float("nan")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*held, None])], "i long, x double")
    got = rows.select(*[X.fixed(F.col("x"), n, p).alias(f"n{n}p{p:d}") for n in (0, 1, 2, 4) for p in (False, True)], "i").orderBy("i").collect()
    for x, r in zip(held, got):
        assert [*r[:-1]] == [format(x, f"{'+' * p}.{n}f") for n in (0, 1, 2, 4) for p in (False, True)]
    assert set(got[-1][:-1]) == {None}
    said = {1.25e9: "1.2B", -2.25e6: "-2.2M", 1250.0: "1.2K", 142.35: "142.3", 0.005: "0.0050", 1.005: "1.00", 0.0: "0.00", None: None}
    got = spark.createDataFrame([(x,) for x in said], "x double").select("x", queues.value_label(F.col("x"), "USD").alias("label")).collect()
    assert {r.x: r.label for r in got} == said


def test_times(spark):
    r = one(spark, naive=S.zoned(F.lit("2020-01-01T10:00:00")), zoned=S.zoned(F.lit("2020-01-01T10:00:00+02:00")).cast("string"), local=S.decision_time(F.lit("2020-01-02T09:30:00")).cast("string"))
    assert r.naive is None and r.zoned == "2020-01-01 08:00:00" and r.local == "2020-01-02 14:30:00"
    r = one(spark, a=S.regime_of(F.lit("2011-07-31").cast("timestamp_ntz")), b=S.regime_of(F.lit("2023-05-01").cast("timestamp_ntz")), c=S.split_of(F.lit("2021-10-01").cast("timestamp_ntz")))
    assert (r.a, r.b, r.c) == ("post_gfc_recovery", "pre_banking_stress_oos", "test")


def test_diversity():
    rows = pd.DataFrame({"query_id": 1, "doc_id": list("abcdefg"), "final_score": [0.9, 0.8, 0.8, 0.7, 0.6, 0.5, 0.1], "cluster": list("xxyzuvw"), "matched_tickers": [["A"]] * 5 + [[], []], "evidence_scope": ["stock"] * 5 + ["sector", "market"]})
    got = retrieval.pick_diverse(rows, 4, retrieval.Diversity())
    # The sector slot takes the place of the lowest row of any other scope, the market row included.
    assert got["doc_id"].tolist() == ["a", "c", "d", "f"] and got["rank"].tolist() == [1, 2, 3, 4]
    assert retrieval.pick_diverse(rows.head(2), 4, retrieval.Diversity(minimum={}))["doc_id"].tolist() == ["a", "b"]


def test_min_max_of_flat_groups(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (3, 1.0), (3, 5.0)], "q int, v double").select("q", retrieval.min_max(F.col("v"), ["q"]).alias("s"))
    assert sorted((r.q, r.s) for r in df.collect()) == [(1, 1.0), (1, 1.0), (2, 0.0), (3, 0.0), (3, 1.0)]


def test_metrics_divide_by_k(spark):
    run = spark.createDataFrame([("m", 1, 10, 1), ("m", 1, 11, 2)], "method string, query_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 11, 3), (1, 99, 3)], "query_id int, doc_id int, relevance int")
    r = evaluation.metrics(run, qrels, 2, 5).first()
    assert (r.p_small, r.p, r.ap, r.rr) == (0.5, 0.2, 0.5, 0.5) and 0 < r.ndcg < 0.5
    assert evaluation.metrics(run.limit(0), qrels).count() == 0


def test_first_wins_keeps_empty_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4), ("", 5)], "k string, n int")
    assert sorted(r.n for r in selection.first_wins(df, ["k"], ["n"]).collect()) == [1, 3, 4, 5]


def test_as_of_and_windows(spark):
    days = spark.createDataFrame([("T", "2020-01-02"), ("T", "2020-01-05")], "tic string, date string").withColumn("date", F.to_date("date"))
    events = spark.createDataFrame([(1, "T", "2020-01-02"), (2, "T", "2020-01-03"), (3, "T", "2020-01-06"), (4, "U", "2020-01-01")], "id int, tic string, event_date string").withColumn("event_date", F.to_date("event_date"))
    got = {r.id: str(r.trading_date) for r in panel.first_day_on_or_after(events, days).collect()}
    assert got == {1: "2020-01-02", 2: "2020-01-05", 3: "None", 4: "None"}


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5), (1, 1, 0.9), (1, 0, 0.1), (2, 1, 0.3)], "g int, y int, s double")
    got = {r.g: r.auc for r in stats.auc(df, ["g"], "y", "s").collect()}
    assert got == {1: 0.875, 2: None}
    assert stats.redundant({("a", "b"): 0.99, ("a", "c"): 0.1, ("b", "c"): 0.2}, ["a", "b", "c"]) == ["a", "c"]


def test_urls(spark):
    r = one(spark, a=linking.canonical_url(F.lit("HTTPS://WWW.Ex.com:443/a//?b=2&utm_source=x&a=1#f")), b=linking.canonical_url(F.lit("no url")), h=linking.host(F.lit("http://www.Ex.com:80/x")), d=linking.url_date(F.lit("http://x/2020/13/45")).cast("string"))
    assert (r.a, r.b, r.h, r.d) == ("https://www.ex.com/a?a=1&b=2", "no url", "ex.com", None)


def test_link_phrases(spark):
    docs = spark.createDataFrame([(1, "Acme-Corp rose"), (2, "acme corps"), (3, None)], "doc_id int, body string")
    names = spark.createDataFrame([("A", "Acme Corp"), ("A", "acme corp"), ("B", "")], "entity string, name string")
    assert [(r.doc_id, r.entity) for r in linking.link_phrases(docs, names).collect()] == [(1, "A")]


def test_sections(spark):
    from tidemark.functions import filings

    def sections(text, form):
        return one(spark, s=filings.sections(F.lit(text).cast("string"), F.lit(form).cast("string"))).s

    text = "Item 1A. Risk Factors 4\nItem 7. Discussion 9\nItem 1A. Risk Factors\n" + "risk " * 80 + "\nItem 7. Discussion\nshort"
    got = sections(text, "10-K")
    assert [(s["section_id"], s["title"]) for s in got] == [("item_1a_risk_factors", "Risk Factors")]
    assert [s["section_id"] for s in sections("Item 5.07. Vote\nall for", "8-K")] == ["item_5_07_shareholder_vote"]
    assert [s["section_id"] for s in sections("no headings", "10-K")] == ["full_filing"] and sections(None, None) == []


def test_sources(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "docs.jsonl").write_text('{"doc_id": "a", "title": "T", "body": "B", "published_at": "2020-01-01T00:00:00Z", "tickers_detected": ["aa", "market"]}\n\n{"doc_id": "b", "published_at": "2020-01-01T00:00:00"}\n')
    rows = files.with_defaults(files.read_documents(spark, str(tmp_path / "docs.jsonl"))).collect()
    assert [r.doc_id for r in rows] == ["a"]
    r = rows[0]
    assert r.available_at == "2020-01-01T00:00:00Z" and r.matched_holdings == ["AA"] and r.source_credibility == 0.5 and len(r.document_hash) == 64
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_documents(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "panel.csv").write_text("Date,symbol,close\n2020-01-01,aa,1.5\n2020-01-02,bb,x\n,cc,1\n")
    p = files.read_panel(spark, str(tmp_path / "panel.csv"))
    assert sorted((r.tic, r.close) for r in p.collect()) == [("AA", 1.5), ("BB", None)] and files.universe(p).count() == 2
    with pytest.raises(ValueError, match="missing"):
        files.read_table(spark, str(tmp_path / "panel.csv"), required=("query_id",))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert files.append_new(df, str(tmp_path / "t"), "k") == 2 and files.append_new(df, str(tmp_path / "t"), "k") == 0
    assert files.arrays_to_rows(spark.sql("SELECT 1 AS id, array('x', 'y') AS a, array(3, 4) AS b"), "a", "b").count() == 2
    assert files.union_by_name(df, df.withColumn("w", F.lit(1))).columns == ["k", "v", "w"]
