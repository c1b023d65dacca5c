"""Queries that have no SQL, against plain versions: greedy selection, fits, streams."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import retrieval as R
from tidemark.plans import handoff, registry
from tidemark.plans.retrieval import candidates
from tidemark.plans.roles import judgments
from tidemark.streaming import documents as live

registry.load()
SF = "/root/testdata/sf0.001"


def greedy(rows, k):
    """One query's selection, rule by rule: at most one row a cluster and four a holding, then without the holdings' cap, then freely."""
    rows = sorted(rows, key=lambda r: (-r["final_score"], r["doc_id"]))
    taken = []
    for caps in ("both", "clusters", "none"):
        for r in rows:
            if len(taken) == k or r in taken:
                continue
            if caps != "none" and any(t["cluster"] == r["cluster"] for t in taken):
                continue
            if caps == "both" and r["held"] and all(sum(h in t["held"] for t in taken) >= 4 for h in r["held"]):
                continue
            taken.append(r)
    for scope in ("market", "sector"):
        if any(t["scope"] == scope for t in taken):
            continue
        new = next((r for r in rows if r["scope"] == scope and r not in taken and r["cluster"] not in {t["cluster"] for t in taken}), None)
        if new is None:
            continue
        if len(taken) == k:
            others = [t for t in taken if t["scope"] != scope]
            if not others:
                continue
            taken.remove(min(others, key=lambda t: (t["final_score"], t["doc_id"])))
        taken.append(new)
    return [r["doc_id"] for r in sorted(taken, key=lambda r: (-r["final_score"], r["doc_id"]))][:k]


def test_diversified_topk(spark):
    got: dict = {}
    for r in registry.QUERIES["diversified_topk"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    rows: dict = {}
    found = candidates(spark, SF).withColumn("final_score", F.round(R.final_score("full_hybrid_diversified"), 6))
    for r in found.select("query_id", "doc_id", "final_score", "cluster", F.col("matched_tickers").alias("held"), F.col("evidence_scope").alias("scope")).collect():
        rows.setdefault(r.query_id, []).append(r.asDict())
    assert got == {q: greedy(own, 10) for q, own in rows.items()}


def scaled(rows):
    train, test = rows[rows.doc_id % 3 != 0].copy(), rows[rows.doc_id % 3 == 0].copy()
    names = [c for c in rows.columns if c not in ("doc_id", "y", "size_")]
    for c in names:
        # The median of Spark's imputer is a value that occurs.
        middle = np.sort(train[c].dropna())[math.ceil(train[c].notna().sum() / 2) - 1]
        mean, spread = train[c].fillna(middle).mean(), train[c].fillna(middle).std(ddof=0)
        train[c], test[c] = ((x[c].fillna(middle) - mean) / spread for x in (train, test))
    return train, test, names


def test_volatility_ridge(spark):
    rows = handoff._model_rows(spark, SF).toPandas()
    train, test, _ = scaled(rows[["doc_id", "odd", "severity"]])
    y = rows.set_index("doc_id")["size"]
    x = train[["odd", "severity"]].to_numpy()
    own = y[train.doc_id].to_numpy()
    weights = np.linalg.solve(x.T @ x + 10 * np.eye(2), x.T @ (own - own.mean()))
    want = dict(zip(test.doc_id, test[["odd", "severity"]].to_numpy() @ weights + own.mean(), strict=True))
    got = {r.doc_id: r.prediction for r in registry.QUERIES["volatility_ridge"](spark, SF).collect()}
    assert got == {d: pytest.approx(p, abs=2e-4) for d, p in want.items()}


def test_risk_classifier(spark):
    rows = handoff._model_rows(spark, SF).toPandas().rename(columns={"size": "length"})
    train, test, names = scaled(rows[["doc_id", "length", "odd", "severity"]])
    y = rows.set_index("doc_id")["y"]
    own = y[train.doc_id].to_numpy()
    x = np.column_stack([train[names].to_numpy(), np.ones(len(train))])
    weight = np.where(own == 1, len(own) / (2 * own.sum()), len(own) / (2 * (len(own) - own.sum())))
    b = np.zeros(x.shape[1])
    penalty = np.diag([1.0] * len(names) + [0.0])  # over n rows, as Spark's mean loss has it
    for _ in range(200):  # Newton's steps on the same loss
        p = 1 / (1 + np.exp(-x @ b))
        slope = x.T @ (weight * (p - own)) / weight.sum() + penalty @ b / len(own)
        b -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x / weight.sum() + penalty / len(own), slope)
    want = dict(zip(test.doc_id, 1 / (1 + np.exp(-(np.column_stack([test[names].to_numpy(), np.ones(len(test))]) @ b))), strict=True))
    got = {r.doc_id: r.p for r in registry.QUERIES["risk_classifier"](spark, SF).collect()}
    assert set(got) == set(want) and all(abs(got[d] - want[d]) < 5e-3 for d in got)


def test_reranker_fit(spark):
    items, qrels = handoff._items(spark, SF).toPandas(), judgments(spark, SF).toPandas()
    ideal = {q: sum((2.0**r - 1) / math.log2(i + 2) for i, r in enumerate(sorted(own.relevance, reverse=True)[:10])) for q, own in qrels.groupby("query_id")}

    def value(w):
        scored = items.assign(s=sum(v * items[f] for f, v in w.items()).round(12)).sort_values(["s", "rank", "doc_id"], ascending=[False, True, False])
        got = []
        for q, own in scored.groupby("query_id", sort=False):
            dcg = sum((2.0 ** (0 if pd.isna(r) else r) - 1) / math.log2(i + 2) for i, r in enumerate(own.relevance[:10]))
            got.append(dcg / ideal[q] if ideal.get(q, 0) > 0 else 0.0)
        return sum(got) / len(got)

    weights = dict(handoff._START)
    for name in weights:
        best, keep = value(weights), weights[name]
        for g in handoff._GRID:
            if (v := value(weights | {name: g})) > best + 1e-12:
                best, keep = v, g
        weights[name] = keep
    assert {r.feature: r.weight for r in registry.QUERIES["reranker_fit"](spark, SF).collect()} == weights


def test_cross_validation_scores_each_fold_with_weights_of_the_others(spark):
    items, qrels = handoff._items(spark, SF), judgments(spark, SF)
    folds = items.select("query_id").distinct().withColumn("fold", F.col("query_id") % 2)
    got = M.cross_validate(items, qrels, folds, handoff._START, handoff._GRID)
    for f, v in enumerate(got):
        w = M.fit_weights(items.filter(F.col("query_id") % 2 != f), qrels.filter(F.col("query_id") % 2 != f), handoff._START, handoff._GRID, 1)
        assert M.objective(items.filter(F.col("query_id") % 2 == f), qrels.filter(F.col("query_id") % 2 == f), [w]) == [pytest.approx(v)]


def test_stream_daily_counts(spark):
    """Days that the watermark has passed, which the last two days of the table haven't."""
    sql = f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*), round(avg(value), 6) FROM '{SF}/events.parquet' GROUP BY ALL"
    every = {(d, e): (n, m) for d, e, n, m in duckdb.sql(sql).fetchall()}
    got = {(r.day[:10], r.event_type): (r.n, r.mean) for r in registry.QUERIES["stream_daily_counts"](spark, SF).collect()}
    last = max(d for d, _ in every)
    assert all(every[k] == (n, pytest.approx(m, abs=1e-6)) for k, (n, m) in got.items())
    assert {k for k in every if k not in got} <= {k for k in every if k[0] >= str(pd.Timestamp(last).date() - pd.Timedelta(days=1))} and got


def test_stream_meets_stored_decisions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"2020-01-{1 + i % 20:02d} 0{i % 10}:00:00") for i in range(60)], "doc_id long, at string").select("doc_id", F.col("at").cast("timestamp").alias("available_at"))
    decisions = spark.createDataFrame([(q, f"2020-01-{5 * q + 1:02d} 05:30:00") for q in range(4)], "query_id long, at string").select("query_id", F.col("at").cast("timestamp").alias("decision_time"))
    docs.write.parquet(str(tmp_path / "in"))
    run = live.with_decisions(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), decisions, 7).writeStream.format("memory").queryName("met").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.query_id, r.doc_id) for r in spark.table("met").collect()}
    week = pd.Timedelta(days=7)
    want = {(q.query_id, d.doc_id) for q in decisions.toPandas().itertuples() for d in docs.toPandas().itertuples() if q.decision_time - week <= d.available_at <= q.decision_time}
    assert got == want and want
