"""Query sets, runs, manifests and packages, and rules on columns' names."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import filings
from tidemark.operators import actions as A
from tidemark.operators import queues as Q
from tidemark.sources import files, packages


def test_queries_are_checked(spark):
    rows = [("a", "words", "x", "", ""), ("b", "more", "x", "", "")]
    names = "query_id string, query string, intent string, expected_ticker string, source_scope string"
    assert packages.checked_queries(spark.createDataFrame(rows, names)).count() == 2
    for bad in ([*rows, ("a", "again", "", "", "")], [("c", " ", "", "", "")], []):
        with pytest.raises(ValueError, match="queries"):
            packages.checked_queries(spark.createDataFrame(bad, names))
    with pytest.raises(ValueError, match="missing: intent"):
        packages.checked_queries(spark.createDataFrame(rows, names).drop("intent"))


def test_runs_are_written_and_appended(spark, tmp_path):
    run = spark.createDataFrame([("q", "d1", 1, 0.5, ["a", "b"]), ("q", "d2", 2, 0.25, [])], "query_id string, doc_id string, rank int, score double, tags array<string>")
    path = str(tmp_path / "run")
    packages.write_run(run, path, ("query_id", "doc_id", "rank", "score", "method", "tags"))
    packages.write_run(run.withColumn("rank", F.col("rank") + 2), path, ("query_id", "doc_id", "rank", "score", "method", "tags"), append=True)
    got = packages.read_run(spark, path).collect()
    assert [(r.doc_id, r.rank, r.method) for r in got] == [("d1", 1, "run"), ("d2", 2, "run"), ("d1", 3, "run"), ("d2", 4, "run")] and got[0].tags == "a|b"
    assert packages.read_columns(spark, path, ("score", "nothing", "rank")).columns == ["score", "rank"]


def test_manifest_tells_an_index_that_is_out_of_date(spark, tmp_path):
    source, manifest = str(tmp_path / "docs"), str(tmp_path / "manifest")
    spark.range(5).write.json(source)
    assert not packages.usable(spark, manifest, source)
    packages.write_manifest(spark, manifest, source, {"documents": 5})
    assert packages.usable(spark, manifest, source) and not packages.usable(spark, manifest, str(tmp_path / "other"))
    spark.range(500).write.mode("append").json(source)
    assert not packages.usable(spark, manifest, source)


def test_packages_have_buckets_and_a_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "x"), (2, "test", "é"), (3, "train", None)], "id long, split string, text string")
    packages.write_package(str(tmp_path), {"contexts": rows, "empty": rows.limit(0).drop("split")}, "split")
    assert {r.name: r.rows for r in spark.read.json(f"{tmp_path}/manifest").collect()} == {"contexts": 3, "empty": 0}
    assert {r.id for r in spark.read.json(f"{tmp_path}/contexts/split=train").collect()} == {1, 3}


def test_append_new_reads_what_is_there(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(4).withColumn("v", F.lit(1))
    assert (files.append_new(df, path, "id"), files.append_new(df.union(df.withColumn("id", F.col("id") + 10)), path, "id")) == (4, 4)
    assert spark.read.parquet(path).count() == 8
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not a table")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.append_new(df, str(tmp_path / "broken"), "id")


def test_columns_by_name(spark):
    assert A.text_features(["ret", "stock_text_avg_x", "portfolio_signal_y", "stock_z"]) == ["portfolio_signal_y", "stock_text_avg_x"]
    df = spark.createDataFrame([(None, None, 1.0)], "stock_text_avg_x double, regime string, other double")
    assert A.filled(df).first() == (0.0, "", 1.0)


def test_lean_features(spark):
    names = "feature string, train_std double, is_provenance_like int, train_nonzero_rate double, train_only_screen_score double, best_abs_train_spearman double"
    rows = [(f"stock_text_{i}", 1.0, 0, 0.5, 1.0 - i / 10, 0.1) for i in range(5)] + [("stock_text_flag", 1.0, 0, 0.5, 9.0, 0.1), ("portfolio_text_a", 1.0, 0, 0.005, 9.0, 0.1), ("portfolio_text_b", 1.0, 0, 0.02, 1.0, 0.1), ("stock_text_src", 1.0, 1, 0.5, 9.0, 0.1)]
    pairs = spark.createDataFrame([("stock_text_1", "stock_text_0", -0.97), ("stock_text_1", "stock_text_2", 0.99), ("stock_text_3", "stock_text_2", 0.5)], "a string, b string, spearman double")
    assert A.lean_features(spark.createDataFrame(rows, names), pairs, stock=3) == ["portfolio_text_b", "stock_text_0", "stock_text_2", "stock_text_3"]


def test_repeated_keys_are_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "k int, v string")
    assert A.one_row_each(df.filter("v = 'a'"), ["k"]).count() == 2
    with pytest.raises((PySparkException, Py4JJavaError), match="repeated key"):
        A.one_row_each(df, ["k"]).collect()


def test_empty_inputs(spark):
    rows = spark.createDataFrame([], "model int, real string, predicted string")
    assert Q.fit_metrics(rows, ["model"]).count() == 0
    pool = spark.createDataFrame([(1, 1, None, "g", [4]), (1, 2, 4, "g", None)], "query_id int, surface_rank int, doc_id long, group_key string, children array<bigint>")
    assert sorted((r.doc_id, r.surface_rank, r.child_rank) for r in Q.merged_pool(Q.pool_of(pool)).collect()) == [(4, 1, 1)]


def test_sections_of_forms(spark):
    """Codes, titles, tables of contents, places and titles that headings lack."""
    text = "front\nPART I  ITEM 1. Financial statements 3\nItem 2\n" + "x" * 300 + "\n  Item 1A - Risk\tfactors.\n" + "y" * 260 + "\nitem 1: legal matters\nshort"
    report = "Item 2.02 Results\nfine\nItem 3.33\nother\nITEM 2.02\nlonger than before\n" + "item 9.01\n\n" + "z" * 200
    rows = [("a", "10-Q", text), ("b", "8-k", report), ("c", "10-K", "no items"), ("d", "10-K", "  \n"), ("e", None, None)]
    got = filings.explode_sections(spark.createDataFrame(rows, "id string, form string, text string")).collect()
    by = {(r.id, r.section_id): r for r in got}
    assert set(by) == {("a", "part1_item_2_mda"), ("a", "part2_item_1a_risk_factors"), ("b", "item_2_02_results_operations_financial_condition"), ("b", "item_3_33_current_report"), ("b", "item_9_01_financial_statements_exhibits"), ("c", "full_filing")}
    mda, risk, results = by["a", "part1_item_2_mda"], by["a", "part2_item_1a_risk_factors"], by["b", "item_2_02_results_operations_financial_condition"]
    assert mda.title == "Management Discussion and Analysis" and mda.body == "Item 2. Management Discussion and Analysis\n" + "x" * 300
    assert text[mda.start_char : mda.end_char].strip() == "Item 2\n" + "x" * 300 and (risk.title, risk.item_code) == ("Risk factors", "1A")
    # White space after a code may be a line's end: a short line that follows is the title.
    assert results.body == "Item 2.02. longer than before" and by["b", "item_3_33_current_report"].body == "Item 3.33. other"
    assert by["b", "item_9_01_financial_statements_exhibits"].body == "Item 9.01. 8-K Item 9.01\n" + "z" * 200
    assert (by["c", "full_filing"].body, by["c", "full_filing"].end_char) == ("no items", 8)


def test_references(spark):
    said = "a &amp;amp; b &lt;x&gt; &#8217;&#x2014;&rsquo;&apos; &nope; & &#0; &#55296; &eacute;t&eacute; &#128512;&"
    got = spark.createDataFrame([(said,), (None,), ("",)], "t string").select(filings.unescape(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["a &amp; b <x> ’—’' &nope; & � � été 😀&", "", ""]
