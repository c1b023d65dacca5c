"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A passage is PASSAGE words. Each is described by shares of character classes, word statistics and hashed words, and encoded by one
hidden layer; gated attention weighs the passages of a text, and the weighted sum is scored. All of it, attention included, is learned
from labels of whole texts by Adam in numpy. Only the text is an input.

It is fitted on at most `most` labelled texts, those with the smallest hash of their doc_id, and of each on at most `each` passages at
even distances, first and last included; the features are made where the texts are, and only numbers travel to the driver: at most
most * each * FEATURES two-byte numbers, 42 MB. Scoring reads every passage of every text.

Defined cases: null and empty texts have one passage without words; labels that are null are left out, and of several labels of a
doc_id the largest holds; without labels every score is 0.5; repeated rows are scored each; other columns pass through; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytesops as B
from tidemark.plans.shipping import ship

PASSAGE, HASHED, HIDDEN, GATE = 64, 64, 32, 16
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "#", "*", "$%&", "|<>{}[]\\/", "'\"()-")
_CLASS = np.full(256, len(_CLASSES), dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASS = len(_CLASSES) + 2
FEATURES = _N_CLASS + 6 + HASHED


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage (float32), and the text it is of; every text has one at least."""
    start, end, row = B.words(data, at)
    n = np.bincount(row, minlength=len(at) - 1)
    per = np.maximum(1, -(-n // PASSAGE))
    base, first = np.cumsum(per) - per, np.cumsum(n) - n
    total, text_of = int(per.sum()), np.repeat(np.arange(len(n)), per)
    out = np.zeros((total, FEATURES), np.float32)
    if not len(start):
        return out, text_of
    own = base[row] + (np.arange(len(start)) - first[row]) // PASSAGE
    words = np.bincount(own, minlength=total).astype(np.float32)
    safe = np.maximum(words, 1)
    # A byte belongs to the passage of the word that it is in or that follows it, at a text's end to the last.
    cuts = np.zeros(len(data) + 1, np.int64)
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    begin = start[heads].copy()
    opens = np.append(True, row[heads][1:] != row[heads][:-1])
    begin[opens] = at[row[heads][opens]]
    cuts[begin] += np.diff(own[heads], prepend=0)
    of_byte = np.cumsum(cuts[:-1])
    counts = np.bincount(of_byte * _N_CLASS + _CLASS[data], minlength=total * _N_CLASS).reshape(total, _N_CLASS)
    out[:, :_N_CLASS] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    size = (end - start).astype(np.float32)
    lower = B.LOWER[data]
    h = B.span_hashes(B.prefix_hashes(lower), start, end)
    mean = np.bincount(own, size, total) / safe
    same = np.zeros(len(h), np.float32)
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    key = np.sort(own.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    fresh = np.append(True, key[1:] != key[:-1])
    more = (mean / 10, np.sqrt(np.maximum(np.bincount(own, size * size, total) / safe - mean**2, 0)) / 10, np.bincount(own, same, total) / safe, np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=total) / safe, np.bincount(own, size <= 3, total) / safe, np.log1p(words) / 5)
    for k, x in enumerate(more):
        out[:, _N_CLASS + k] = x
    bucket = (h % np.uint64(HASHED)).astype(np.int64)
    out[:, _N_CLASS + 6 :] = np.bincount(own * HASHED + bucket, minlength=total * HASHED).reshape(total, HASHED) / safe[:, None]
    return out, text_of


def _forward(m: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, text_of: np.ndarray) -> dict[str, np.ndarray]:
    """All layers for passages x; those of a text are neighbours and begin at `begin`."""
    x = (x - m["mean"]) / m["scale"]
    h = np.tanh(x @ m["W"] + m["b"])
    v, u = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-np.clip(h @ m["U"], -30, 30)))
    e = (v * u) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, begin)[text_of])
    a = e / np.add.reduceat(e, begin)[text_of]
    z = np.add.reduceat(h * a[:, None], begin)
    logit = z @ m["c"] + m["d"][0]
    return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def _gradients(m: dict[str, np.ndarray], s: dict[str, np.ndarray], y: np.ndarray, begin: np.ndarray, text_of: np.ndarray) -> dict[str, np.ndarray]:
    g = (s["p"] - y) / len(y)
    dz = g[:, None] * m["c"]
    dh = s["a"][:, None] * dz[text_of]
    da = (s["h"] * dz[text_of]).sum(axis=1)
    de = s["a"] * (da - np.add.reduceat(s["a"] * da, begin)[text_of])
    dv, du = de[:, None] * m["w"] * s["u"] * (1 - s["v"] ** 2), de[:, None] * m["w"] * s["v"] * s["u"] * (1 - s["u"])
    dh += dv @ m["V"].T + du @ m["U"].T
    dk = dh * (1 - s["h"] ** 2)
    return {"c": s["z"].T @ g, "d": np.array([g.sum()]), "w": (s["v"] * s["u"]).T @ de, "V": s["h"].T @ dv, "U": s["h"].T @ du, "W": s["x"].T @ dk, "b": dk.sum(axis=0)}


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> dict[str, np.ndarray]:
    """A model from the passages of labelled texts, one text after another."""
    rng = np.random.default_rng(seed)
    shapes = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,)}
    m = {k: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float64) for k, s in shapes.items()}
    m |= {"b": np.zeros(HIDDEN), "d": np.zeros(1), "mean": np.zeros(FEATURES), "scale": np.ones(FEATURES)}
    if not len(y):
        return m | {"c": np.zeros(HIDDEN)}
    m["mean"], m["scale"] = x.mean(axis=0), x.std(axis=0) + 0.01
    share = np.clip(y.mean(), 0.01, 0.99)
    m["d"] = np.array([np.log(share / (1 - share))])
    first, step = np.cumsum(sizes) - sizes, 0
    mean, square = ({k: np.zeros_like(m[k]) for k in ("W", "V", "U", "w", "c", "b", "d")} for _ in range(2))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            docs = order[i : i + batch]
            n = sizes[docs]
            begin, text_of = np.cumsum(n) - n, np.repeat(np.arange(len(docs)), n)
            s = _forward(m, x[B.ragged(first[docs], n)], begin, text_of)
            step += 1
            for k, g in _gradients(m, s, y[docs], begin, text_of).items():
                g = g + decay * m[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                m[k] = m[k] - rate * (1 - epoch / epochs) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return m


def _even(n: int, most: int) -> np.ndarray:
    """Places of at most `most` of n passages, at even distances."""
    return np.arange(n) if n <= most else np.rint(np.linspace(0, n - 1, most)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, each: int = 64) -> dict[str, np.ndarray]:
    """Fits on the `most` labelled texts with the smallest hash of doc_id, `each` passages a text; labels has doc_id and label (0 or 1)."""
    ship(docs.sparkSession)
    chosen = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most `most` rows of two numbers: small enough to send
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, e, data, at in B.chunks(*B.utf8(batch.column(1))):
                x, text_of = passages(data, at)
                cuts = np.searchsorted(text_of, np.arange(e - f + 1))
                raw = [x[begin:end][_even(end - begin, each)].astype(np.float16).tobytes() for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(f, e - f), batch.column(2).slice(f, e - f), pa.array(raw, pa.binary())], names=["doc_id", "label", "x"])

    rows = found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(B.trimmed(run), "doc_id long, label double, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    xs = [np.frombuffer(r.x, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in rows]
    return fit(np.concatenate(xs) if xs else np.zeros((0, FEATURES)), np.array([len(x) for x in xs], dtype=np.int64), np.array([r.label for r in rows]))


def score(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) to the columns `keep` of docs, all by default."""
    ship(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for f, e, data, at in B.chunks(*B.utf8(batch.column(len(keep)))):
                x, text_of = passages(data, at)
                scores.append(_forward(model, x, np.searchsorted(text_of, np.arange(e - f)), text_of)["p"])
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(flat)], names=schema.fieldNames())

    return docs.select(*[docs[c] for c in keep], docs["text"].alias("text_to_score")).mapInArrow(B.trimmed(run), schema)
