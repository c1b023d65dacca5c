r"""Language-model scores by masked pseudo-likelihood: every word is predicted from the words on both sides of it.

A word is a run of bytes other than white space, lower-cased (A-Z). The commonest words of the corpus, counted over all documents, have
an id each; the others share BUCKETS ids by hash. A window network in numpy adds vectors of the WINDOW words to the left and to the
right, squashes the sum, and predicts the masked word's id as a class and a member of it. A word of a shared id has, beyond that, its own share of
the id by the counts of all words; a word that was never counted has one part of the id's count plus one, spelled byte by byte. It starts from the corpus's word counts and
is trained on every document: rows are dealt by a hash of text and doc_id to one of ROUNDS rounds and to a shard; in each round every
shard trains its own copy on its texts in the order of their hashes, in batches of BATCH words that run across texts, and the copies
are averaged by the words they have seen. Shards follow from the number of words alone (a shard about SHARD words, more words a shard
from MANY shards on), so neither the number of tasks, nor of machines, nor lost executors move a score. What is gathered grows with the
corpus: counts of all its words, and a copy for each shard, added up where it was trained and then in a tree of sums; the driver gets
the chosen words and one model. Words of shared ids meet the table of counts in packed parts by hash, which no machine holds whole.
Sums are of whole numbers, so their order doesn't matter.

Defined cases: null and empty texts have no words, a log_likelihood of 0 and a null per_word; rows with a null doc_id are scored and
trained on; repeated rows count each; very long texts are read whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesops as B
from tidemark.llm.runtime import cut, partitions
from tidemark.plans.shipping import ship

CLASSES, MEMBERS, BUCKETS, WIDTH, WINDOW, ROUNDS = 64, 64, 64, 24, 2, 2
IDS = CLASSES * MEMBERS
EDGE = IDS  # stands beyond the ends of a text
BATCH, RATE = 4096, 0.1
#: Words of a shard, and the number of shards from which on they get larger instead of more.
SHARD, MANY = 1 << 20, 1024
#: Weights are summed as whole numbers of 2**-20, each times the thousands of words a copy has seen.
FIXED = 1 << 20
#: Logarithms of shares are summed as whole numbers of 2**-32.
FINE = 1 << 32
#: Words of shared ids that a task packs at once.
PACK = 1 << 20
SPELL = float(np.log(257))  # a byte or the end of a word
Net = dict[str, np.ndarray]


def text_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bytes of each word, and the number of words of each text."""
    data = B.LOWER[data]
    start, end, row = B.words(data, at)
    h = B.word_hashes(data, start, end)
    return h, end - start, np.bincount(row, minlength=len(at) - 1)


def text_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each text."""
    h, _, counts = text_spans(data, at)
    return h, counts


def count_words(docs: DataFrame) -> DataFrame:
    """word (its hash) and n, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_words(data, at)[0] for _, _, data, at in B.chunks(*B.utf8(batch.column(0)), 8 * B.CHUNK)]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(B.trimmed(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids of words: 0 on for chosen words, commonest first, then BUCKETS ids that the rest share."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> None:
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.counts = np.concatenate([counts, np.zeros(IDS - BUCKETS - len(counts)), buckets])

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = (IDS - BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)).astype(np.int32)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            known = self.words[at] == h
            out[known] = self.order[at[known]]
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "word").limit(IDS - BUCKETS).collect()
    words = np.array([r.word for r in top], dtype=np.int64).view(np.uint64)
    own = np.array([r.n for r in top], dtype=np.float64)
    # A hash is read as signed by Spark; adding 2**64 to a negative one changes no remainder of a power of two.
    sums = np.zeros(BUCKETS)
    for r in counts.groupBy(F.pmod("word", F.lit(BUCKETS)).alias("b")).agg(F.sum("n").alias("n")).collect():
        sums[r.b] = r.n
    np.subtract.at(sums, (words % np.uint64(BUCKETS)).astype(np.int64), own)
    return Vocabulary(words, own, sums)


def start_net(v: Vocabulary, seed: int = 3) -> Net:
    """Predicts by word counts alone; the vectors are small random numbers."""
    rng = np.random.default_rng(seed)
    p = (v.counts + 0.5).reshape(CLASSES, MEMBERS)
    net = {
        "T": rng.normal(size=(2 * WINDOW, IDS + 1, WIDTH)) * 0.3, "b": np.zeros(WIDTH),
        "Wc": np.zeros((WIDTH, CLASSES)), "bc": np.log(p.sum(axis=1) / p.sum()),
        "Ec": rng.normal(size=(CLASSES, WIDTH)) * 0.1, "Wr": np.zeros((WIDTH, MEMBERS)), "br": np.log(p / p.sum(axis=1, keepdims=True)),
    }
    return {k: x.astype(np.float32) for k, x in net.items()}


def windows(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word the ids around it, left to right; EDGE beyond the text."""
    place = np.arange(len(ids)) + np.repeat((np.arange(len(counts)) + 1) * WINDOW, counts)
    wide = np.full(len(ids) + (len(counts) + 1) * WINDOW, EDGE, np.int32)
    wide[place] = ids
    return np.stack([wide[place + k] for k in range(-WINDOW, WINDOW + 1) if k])


def _softmax(z: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, written over z, and the log-probability of each row's own place; z is held within -60 to 60."""
    np.clip(z, -60, 60, out=z)
    at = z[np.arange(len(z)), own]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    z *= (1 / total)[:, None]
    return z, at - np.log(total)


def forward(net: Net, around: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Log-probability of each id given the words around it, and what training needs."""
    h = net["T"][0][around[0]]
    for k in range(1, 2 * WINDOW):
        h += net["T"][k][around[k]]
    h += net["b"]
    np.tanh(h, out=h)
    c, r = ids // MEMBERS, ids % MEMBERS
    pc, lc = _softmax(h @ net["Wc"] + net["bc"], c)
    hc = h + net["Ec"][c]
    z = hc @ net["Wr"]
    z += net["br"][c]
    pr, lr = _softmax(z, r)
    return lc + lr, h, hc, pc, pr


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values by row; values are taken over again where there are more rows."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # of two-byte numbers, a radix sort
    own = rows[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[begin], np.add.reduceat(values[order % len(values)], begin)


_SHIFT = (np.arange(2 * WINDOW) * (IDS + 1))[:, None]


def train(net: Net, square: Net, around: np.ndarray, ids: np.ndarray) -> None:
    """Steps of Adagrad over the words, in batches; net and square change in place."""
    table, table_square = net["T"].reshape(-1, WIDTH), square["T"].reshape(-1, WIDTH)
    for f in range(0, len(ids), BATCH):
        x, a = ids[f : f + BATCH], around[:, f : f + BATCH]
        _, h, hc, dc, dr = forward(net, a, x)
        c, n, each = x // MEMBERS, np.arange(len(x)), np.float32(1 / len(x))
        dc[n, c] -= 1
        dr[n, x % MEMBERS] -= 1
        dc *= each
        dr *= each
        dhc = dr @ net["Wr"].T
        dh = (dc @ net["Wc"].T + dhc) * (1 - h * h)
        for k, g in (("Wc", h.T @ dc), ("bc", dc.sum(axis=0)), ("Wr", hc.T @ dr), ("b", dh.sum(axis=0))):
            square[k] += g * g
            net[k] -= RATE * g / np.sqrt(square[k])
        for w, s, rows, values in ((net["Ec"], square["Ec"], c, dhc), (net["br"], square["br"], c, dr), (table, table_square, (a + _SHIFT).ravel(), dh)):
            at, g = _row_sums(rows, values)
            own = s[at] + g * g
            s[at] = own
            w[at] -= RATE * g / np.sqrt(own)


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in sorted(net)])


def _shaped(flat: np.ndarray, like: Net) -> Net:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


class _Copy:
    """A shard's own copy of the net in training."""

    def __init__(self, net: Net) -> None:
        self.net = {k: x.copy() for k, x in net.items()}
        self.square = {k: np.full_like(x, 1e-8) for k, x in net.items()}
        self.ids: list[np.ndarray] = []
        self.around: list[np.ndarray] = []
        self.waiting = self.seen = 0

    def add(self, ids: np.ndarray, around: np.ndarray, last: bool = False) -> None:
        """Trains on whole batches of what has come so far, and with `last` on the rest."""
        self.ids.append(ids)
        self.around.append(around)
        self.waiting += len(ids)
        if self.waiting >= BATCH or last:
            x, a = np.concatenate(self.ids), np.concatenate(self.around, axis=1)
            whole = len(x) if last else len(x) // BATCH * BATCH
            train(self.net, self.square, a[:, :whole], x[:whole])
            self.ids, self.around, self.waiting, self.seen = [x[whole:]], [a[:, whole:]], len(x) - whole, self.seen + whole

    def summed(self) -> tuple[np.ndarray, int]:
        self.add(np.zeros(0, np.int32), np.zeros((2 * WINDOW, 0), np.int32), last=True)
        weight = -(-self.seen // 1000)
        return np.rint(_flat(self.net).astype(np.float64) * FIXED).astype(np.int64) * weight, weight


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all."""
    values, weight = None, 0
    for batch in batches:
        for raw, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.int64)
            values, weight = own + values if values is not None else own, weight + n
    if values is not None:
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([weight])], names=["values", "weight"])


def shards(words: int, rounds: int) -> int:
    """How many copies are trained in a round."""
    each = words // rounds
    return max(1, min(each // SHARD, MANY), each // (SHARD * 64))


def one_round(docs: DataFrame, v: Vocabulary, net: Net, n: int, rounds: int, copies: int) -> Net:
    """Each shard trains a copy on the documents of round n; the average of the copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, weight, now, own = None, 0, None, None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            raw, places = B.utf8(batch.column(2))
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for f, e in zip(cuts[:-1], cuts[1:], strict=True):
                if f == e:
                    continue
                if shard[f] != now:
                    if own is not None:
                        more, many = own.summed()
                        values, weight = more if values is None else values + more, weight + many
                    now, own = shard[f], _Copy(net)
                for _, _, data, at in B.chunks(raw, places[f : e + 1]):
                    h, counts = text_words(data, at)
                    ids = v.ids(h)
                    own.add(ids, windows(ids, counts))
        if own is not None:
            more, many = own.summed()
            values, weight = more if values is None else values + more, weight + many
            yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([weight])], names=["values", "weight"])

    key = F.xxhash64("doc_id", "text")  # with the doc_id, so that copies of one text are dealt to many shards
    rows = docs.select(key.alias("key"), "text").filter(F.col("text").isNotNull() & (F.pmod("key", F.lit(rounds)) == n))
    rows = rows.select(F.pmod(F.shiftrightunsigned("key", 16), F.lit(copies)).alias("shard"), "key", "text")
    parts = max(copies, 1)
    trained = rows.repartition(parts, "shard").sortWithinPartitions("shard", "key").mapInArrow(B.trimmed(run), "values binary, weight long")
    few = math.isqrt(parts)
    if few > 1:
        trained = trained.repartition(few).mapInArrow(_added, "values binary, weight long")
    found = trained.coalesce(1).mapInArrow(_added, "values binary, weight long").collect()
    if not found:
        return net
    return _shaped(np.frombuffer(found[0][0], np.int64) / max(1, found[0].weight) / FIXED, net) if found[0].weight else net


def fit(docs: DataFrame, rounds: int = ROUNDS, counts: DataFrame | None = None) -> tuple[Vocabulary, Net]:
    ship(docs.sparkSession)
    counts = cut(count_words(docs), "words") if counts is None else counts
    v = vocabulary(counts)
    net = start_net(v)
    copies = shards(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], rounds)
    for n in range(rounds):
        net = one_round(docs, v, net, n, rounds, copies)
    return v, net


def _scored(v: Vocabulary, net: Net, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words and log-probability of the ids of each text; hash, bytes and text of the words of shared ids."""
    h, length, counts = text_spans(data, at)
    ids = v.ids(h)
    around, row = windows(ids, counts), np.repeat(np.arange(len(counts)), counts)
    each = [forward(net, around[:, i : i + BATCH], ids[i : i + BATCH])[0] for i in range(0, len(ids), BATCH)]
    total = np.bincount(row, np.concatenate(each), len(counts)) if each else np.zeros(len(counts))
    shared = ids >= IDS - BUCKETS
    return counts, total, h[shared], length[shared], row[shared]


def _rows(ids: pa.Array, counts: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    mean = pa.array(total / np.maximum(counts, 1), mask=counts == 0)
    return pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(total), mean], names=["doc_id", "n_words", "log_likelihood", "per_word"])


SCORES = "doc_id long, n_words long, log_likelihood double, per_word double"


def score(docs: DataFrame, v: Vocabulary, net: Net) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over the words' ids) and per_word; word_scores adds the words' shares of shared ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, e, data, at in B.chunks(*B.utf8(batch.column(1))):
                yield _rows(batch.column(0).slice(f, e - f), *_scored(v, net, data, at)[:2])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(B.trimmed(run), SCORES)


PACKED = "part int, pack long, word binary, number binary, row binary, texts binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("part", "pack", "word", "number", "row", "texts"), r, strict=True)) for r in rows], schema=pa.schema([("part", pa.int32()), ("pack", pa.int64()), *((k, pa.binary()) for k in ("word", "number", "row", "texts"))]))


def _parts(h: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Part of the table of counts, and the places in h of the words that belong there."""
    part = ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(h) else ():
        yield int(part[places[0]]), places


def shares(h: np.ndarray, length: np.ndarray, words: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Log of each word's share of its shared id, in parts of FINE; words are sorted and n are their counts."""
    own = np.zeros(len(h))
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        own = np.where(words[at] == h, n[at], 0)
    whole = np.log(sums[(h % np.uint64(BUCKETS)).astype(np.int64)] + 1)
    return np.rint((np.where(own > 0, np.log(np.maximum(own, 1)), -SPELL * (length + 1.0)) - whole) * FINE).astype(np.int64)


def word_scores(docs: DataFrame, v: Vocabulary, net: Net, counts: DataFrame) -> DataFrame:
    """As score, with every word scored as itself: a word of a shared id adds its share of the id, by counts (word, n)."""
    parts, sums = partitions(docs.sparkSession), v.counts[IDS - BUCKETS :]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, ids, seen, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> pa.RecordBatch:
            first = np.cumsum([0, *(len(x[0]) for x in seen)])
            h, length = (np.concatenate([x[k] for x in seen]) for k in (2, 3))
            row = np.concatenate([x[4] + f for x, f in zip(seen, first, strict=False)]).astype(np.int32)
            texts = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(np.concatenate([x[k] for x in seen])) for k in (0, 1))], names=["doc_id", "n_words", "log_likelihood"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema) as out:
                out.write_batch(texts)
            rows = [(p, pack, h[at].tobytes(), length[at].astype(np.int32).tobytes(), row[at].tobytes(), None) for p, at in _parts(h, parts)]
            return _packed([*rows, (pack % parts, pack, None, None, None, sink.getvalue().to_pybytes())])

        for batch in batches:
            for f, e, data, at in B.chunks(*B.utf8(batch.column(1))):
                ids.append(batch.column(0).slice(f, e - f))
                seen.append(_scored(v, net, data, at))
                size += len(seen[-1][2]) + e - f
                if size >= PACK:
                    yield flush()
                    pack, ids, seen, size = pack + 1, [], [], 0
        if seen:
            yield flush()

    def pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield _packed([(p, -1, h[at].tobytes(), n[at].tobytes(), None, None) for p, at in _parts(h.view(np.uint64), parts)])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        of = lambda kind, k, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(r[k], t) for r in rows if (r["pack"] < 0) == kind and r["texts"] is None)])
        words, n = of(True, "word", np.uint64), of(True, "number", np.int64)
        order = np.argsort(words)
        words, n = words[order], n[order]
        out = []
        for r in rows:
            if r["texts"] is not None:
                out.append((0, r["pack"], None, None, None, r["texts"]))
            elif r["pack"] >= 0:
                row = np.frombuffer(r["row"], np.int32)
                own, at = np.unique(row, return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, at, shares(np.frombuffer(r["word"], np.uint64), np.frombuffer(r["number"], np.int32), words, n, sums))
                out.append((0, r["pack"], None, total.tobytes(), own.tobytes(), None))
        return pa.Table.from_batches([_packed(out)])

    def together(table: pa.Table) -> pa.Table:
        rows = table.select(["number", "row", "texts"]).to_pylist()
        texts = pa.ipc.open_stream(next(r["texts"] for r in rows if r["texts"] is not None)).read_next_batch()
        extra = np.zeros(texts.num_rows, np.int64)
        for r in rows:
            if r["texts"] is None:
                extra[np.frombuffer(r["row"], np.int32)] += np.frombuffer(r["number"], np.int64)
        total = texts.column(2).to_numpy(zero_copy_only=False) + extra / FINE
        return pa.Table.from_batches([_rows(texts.column(0), texts.column(1).to_numpy(zero_copy_only=False), total)])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(B.trimmed(ask), PACKED)
    known = counts.select("word", "n").mapInArrow(B.trimmed(pack_counts), PACKED)
    return asked.union(known).groupBy("part").applyInArrow(answer, PACKED).groupBy("pack").applyInArrow(together, SCORES)


def lm_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_likelihood and per_word of each row."""
    ship(docs.sparkSession)
    counts = cut(count_words(docs), "words")
    return word_scores(docs, *fit(docs, rounds, counts), counts)
