"""Queries that read the whole of their input, against brute force on small tables."""

from __future__ import annotations

import datetime
import re

import duckdb
import pytest

from tidemark.operators.textfeatures import LEXICONS
from tidemark.plans import registry

registry.load()


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def documents(spark, path, rows):
    return put(spark, path, "documents", [(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_sections_of_all_texts(spark, tmp_path):
    long, inner = "Words 12 and an item or two. " * 400, "a" * 300 + "\nItem 1A. Risk Factors\n" + "b" * 400
    rows = [(0, "short"), (1, None), (2, ""), (3, long), (4, "an item of " + "x" * 700), (5, inner), (6, "y" * 249), (7, "z" * 250)]
    got = {(r.doc_id, r.section_id, r.n_chars) for r in registry.QUERIES["section_extract"](spark, documents(spark, tmp_path, rows)).collect()}
    frame = len("Contents\nItem 1A. Risk Factors 4\nItem 7. Discussion 9\nItem 1A. Risk Factors\n") + len("\nItem 7. Discussion\n")
    want = {(i, "full_filing", frame + 2 * len(t)) for i, t in ((0, "short"), (6, "y" * 249))}
    want |= {(i, "full_filing", frame - 1) for i in (1, 2)}
    first, second = len("Item 1A. Risk Factors\n"), len("Item 7. Discussion\n")  # a section begins with its heading
    want |= {(i, s, n + len(t.strip())) for i, t in ((3, long), (4, rows[4][1]), (7, "z" * 250)) for s, n in (("item_1a_risk_factors", first), ("item_7_mda", second))}
    want |= {(5, "item_1a_risk_factors", first + 400), (5, "item_7_mda", second + 300)}
    assert got == want


def test_web_search_ranks_all_documents(spark, tmp_path):
    said = ("Motivation and more", "nothing here", "x" * 80 + " achtung moment", "Nation t3 ment ung")
    rows = [(i, said[i // 29 % 4]) for i in [*range(0, 300), *range(29 * 100, 29 * 140), 29 * 30000 + 3, 29 * 30000 + 6]]
    want = []
    for i, t in rows:
        tickers, low = {i % 29, i * 7 % 29}, t.lower()
        lexical = sum(2.0 * (x in low[:60]) + 1.0 * (x in low) for x in ("ation", "ment", "t3", "ung")) + 2.5 * (3 in tickers)
        score = round(lexical + 1.15 * (i % 10 / 10) + 0.30 * (0.5 + 1 / 10) + (6.0 if 3 in tickers else -10.0), 6)
        if score > 0:
            want.append((-score, -i))
    got = [(r.rank, r.doc_id, r.score) for r in registry.QUERIES["web_search"](spark, documents(spark, tmp_path, rows)).collect()]
    assert sorted(got) == [(n, -i, pytest.approx(-s)) for n, (s, i) in enumerate(sorted(want), 1)]
    assert max(-i for _, i in want) > 744 * 1000


def test_macro_documents_of_all_events(spark, tmp_path):
    ids = [0, 499, 500, 2999, 3000, 99_999, 123_456_789_012]
    sf = put(spark, tmp_path, "events", [(i, float(i)) for i in ids] + [(7, None)], "event_id long, value double")
    got = registry.QUERIES["macro_documents"](spark, sf).collect()
    day = lambda i, lag: datetime.date(2020, 1, 1) + datetime.timedelta(i % 3000 + lag)
    series = lambda i: f"series{i // 3000}" if i >= 3000 else "unrate"
    assert {(r.doc_id, r.available_at) for r in got} == {(f"official_macro_{series(i)}_{day(i, 0)}", f"{day(i, 5)} 14:00:00") for i in ids}
    assert len({r.doc_id for r in got}) == len(ids) == len(got)


def test_chart_labels_round_as_their_sql(spark, tmp_path):
    ids = {6736: 15.51, 13512: 22.38, 44774: 2.97, 48327: 1.07, 87547: 3.4}  # shares of change that end in a half by their shortest decimal only
    rows = [*ids.items(), (7238, -16.3815), (7250, -16.3755), (1, None), (9, None), (18, 2.4996), (3, -0.0), (27, 1e15)]
    sf = put(spark, tmp_path, "events", rows, "event_id long, value double")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    got = {tuple(r) for r in registry.QUERIES["chart_labels"](spark, sf).collect()}
    assert got == set(con.execute(registry.SQL["chart_labels"]).fetchall()) and len(got) == len(rows)


def test_text_rules_of_whole_texts(spark, tmp_path):
    from tidemark.operators import rules
    from tidemark.plans.labels import _SAID

    terms = [w[-1] for w, _ in (*rules.DOCUMENT_TYPES, *rules.INTENTS, *rules.EVENT_TAGS)] + list(rules.RISK_TERMS)
    rows = [(8 * i + 7, "filler " * 2000 + t.upper()) for i, t in enumerate(terms)] + [(8000, None), (8001, "")]
    got = {r.doc_id: r for r in registry.QUERIES["text_rules"](spark, documents(spark, tmp_path, rows)).collect()}
    holds = lambda words, t: any(w in t for w in words)
    first = lambda table, t, default: next((r for w, r in table if holds(w, t)), default)
    for i, body in rows:
        t = ((body or "") + " " + _SAID[i % 8]).lower()
        assert got[i].document_type == first(rules.DOCUMENT_TYPES, t, "company_official_archive")
        assert got[i].intent == first(rules.INTENTS, t, "company_risk" if i % 2 else "macro_growth")
        assert got[i].event_tags == "|".join(sorted(["company_official", *(r for w, r in rules.EVENT_TAGS if holds(w, t))]))
        assert got[i].risk_terms == "|".join(x for x in rules.RISK_TERMS if x in t)


def counted(text):
    n = {k: sum(text.count(t) if " " in t else len(re.findall(rf"\b{t}\w*\b", text)) for t in v) for k, v in LEXICONS.items()}
    words, numbers = max(1, len(re.findall(r"[a-zA-Z][a-zA-Z\-']+", text))), len(re.findall(r"\b\d+(?:\.\d+)?%?\b", text, re.A))
    return n, round(min(1.0, numbers / max(words / 100, 1.0) / 12), 6)


def test_text_features_of_whole_texts(spark, tmp_path):
    from tidemark.plans.textfeatures import _PHRASES

    tags = ("guidance", "risk_factors", "dividend", "macro")
    far = "plain words " * 60
    said = ["Lawsuit and decline, a merger 12 34.5 7", "strong growth; crude oil may rise 4%", "housing credit spread inflation", "x " * 5000 + "weak weak weak", "", "spin-off shortage, real estate 1 2 3"]
    rows = [(i, far + s + (" filler" * 300) + " antitrust") for i, s in enumerate(said)] + [(6, None), (7, "short weak text")]
    sf = documents(spark, tmp_path, rows)
    got = {r.doc_id: r for r in registry.QUERIES["document_features"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, body in rows:
        text = " ".join([body or "", _PHRASES[i % 6], tags[i % 4], "risk", "guidance"]).lower()
        n, density = counted(text)
        r, tag = got[i], tags[i % 4] == "risk_factors"
        assert r.sentiment_proxy == pytest.approx(max(-1, min(1, (n["positive"] - n["negative"]) / max(n["positive"] + n["negative"], 3))), abs=1e-6)
        assert r.risk_intensity == pytest.approx(min(1, (n["negative"] + n["uncertainty"] + 1 + tag) / 10), abs=1e-6)
        assert r.numerical_density == pytest.approx(density, abs=1e-6)
        assert (r.signal_legal_regulatory, r.signal_mna, r.signal_energy, r.signal_housing, r.signal_credit) == tuple(int(n[k] > 0) for k in ("legal_regulatory", "mna", "energy", "housing", "credit"))
    days: dict[tuple[str, str], list[int]] = {}
    for i, _ in rows:
        for t in {f"T{i % 29}", f"T{i * 7 % 29}"}:
            days.setdefault(("2020-01-01", t), []).append(i)
    daily = registry.QUERIES["daily_text_features"](spark, sf).collect()
    assert {(r.date, r.tic) for r in daily} == set(days)
    for r in daily:
        own = days[r.date, r.tic]
        w = {i: max(i % 10 / 10, 0.05) * max(i % 97 / 97, 0.01) for i in own}
        assert r.stock_doc_count == len(own) and r.stock_signal_energy_count == sum(got[i].signal_energy for i in own)
        for column, name in (("risk_intensity", "stock_avg_risk"), ("sentiment_proxy", "stock_avg_sentiment")):
            assert r[name] == pytest.approx(sum(got[i][column] * w[i] for i in own) / sum(w.values()), abs=2e-6)
