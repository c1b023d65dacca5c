"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND for every training passage.

Words are runs of letters and digits, lower-cased (ASCII and Latin-1 letters). Passages are windows of two units, a unit being at
least as long as the longest item, so an item that stands in a text stands whole in one passage of it. A score is the item's BM25
impacts that the passage's words hit, as a share of all the item's impacts. The search runs for all passages of a batch at once:

* pivot: the terms of a block of BLOCK items in order, commonest first, with the largest impact of each in the block; those before
  the point where these maxima add up to `threshold` can't make a hit alone, so only postings from the pivot on give candidates;
* block bound: a candidate block whose maxima over all the passage's words stay under `threshold` is skipped;
* the items of the other blocks are scored in full, and all at or above `threshold` are retrieved.

A hit is confirmed if at least `overlap` of the five-word shingles of the item's question, and of its answer, stand in the passage.
The question ends with the last `?`; without one, the last sentence is the answer; an item of one sentence is halved.

Defined cases: null and empty texts and items have no words and match nothing; repeated rows are hits each; an item_id on several
rows is several items of that name, and items without an id are searched like others, with null in their hits; an empty benchmark or
an empty table gives no rows; extra columns are not read; ids are cast to whole numbers. clean() judges rows by their texts alone: a
null or repeated doc_id neither saves a row nor costs one. An index of up to ITEMS_AT_ONCE items and CHARS_AT_ONCE characters is sent
to the executors; a larger benchmark is searched in blocks within these bounds, one after another, each over all documents; an item of
more characters than that makes a block of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesops as B
from tidemark.llm.runtime import cut
from tidemark.plans.shipping import ship

K1, LENGTH, BLOCK, SHINGLE = 1.2, 0.75, 2, 5
#: Cells of a table of impacts that is held whole.
DENSE = 1 << 23
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 16_000_000
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, the row it is in and its length in bytes."""
    data = B.LOWER[data]
    if len(data) > 1:
        lead = data[:-1] == 0xC3
        big = lead & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][big] += 0x20
    spaced = np.where(_IN_WORD[data], data, np.uint8(32))
    start, end, row = B.words(spaced, at)
    return B.word_hashes(spaced, start, end), row, end - start


def question_and_answer(text: str) -> tuple[str, str]:
    cut_at = text.rfind("?") + 1
    if not 0 < cut_at < len(text.rstrip()):
        ends = [m.end() for m in re.finditer(r"[.!?]+\s+|\n+", text.strip())]
        cut_at = ends[-1] if ends else 0
    if not cut_at:
        words = text.split()
        return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])
    return text[:cut_at], text[cut_at:]


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of `size` words; runs of fewer give none."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = B.mix(out * np.uint64(B.BASE) + h[k : len(h) - size + 1 + k])
    return out


class Index:
    """Inverted index of items with impacts as shares of each item's sum, in blocks with their maxima."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, whole: tuple[int, float, dict[int, int]] | None = None) -> None:
        """whole: items with words, their mean length and in how many items a word is, of a benchmark that these items are a block of."""
        sizes: dict[int, int] = {}

        def as_words(text: str) -> np.ndarray:
            h, _, size = word_hashes(*B.utf8(pa.array([text])))
            sizes.update(zip(h.tolist(), size.tolist(), strict=True))
            return h

        own = [(i, as_words(t), [as_words(x) for x in question_and_answer(t)]) for i, t in items if t]
        own = [x for x in own if len(x[1])]
        self.threshold = threshold - 1e-9
        self.ids = pa.array([x[0] for x in own], pa.int64())
        self.parts = [x[2] for x in own]
        self.longest = max((len(x[1]) for x in own), default=1)
        bags = [Counter(x[1].tolist()) for x in own]
        found = Counter(w for bag in bags for w in bag)
        self.terms = np.array(sorted(found), dtype=np.uint64)
        number = {w: i for i, w in enumerate(self.terms.tolist())}
        rows, mean = len(own), sum(len(x[1]) for x in own) / max(1, len(own))
        if whole:
            rows, mean, found = whole
        term, item, impact = [], [], []
        for j, bag in enumerate(bags):
            size = sum(bag.values())
            raw = {w: np.log1p((rows - found[w] + 0.5) / (found[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH + LENGTH * size / mean)) for w, tf in bag.items()}
            whole = sum(raw.values())
            term += [number[w] for w in raw]
            item += [j] * len(raw)
            impact += [v / whole for v in raw.values()]
        term, item, impact = np.array(term, np.int64), np.array(item, np.int64), np.array(impact, np.float32)
        self.impacts = self._postings(term, item, impact, len(own))
        # Of each block and term the largest impact.
        order = np.lexsort((term, item // BLOCK))
        block, term, impact = (item // BLOCK)[order], term[order], impact[order]
        edge = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        block, term, most = block[edge], term[edge], np.maximum.reduceat(impact, edge) if len(edge) else impact
        self.bounds = self._postings(term, block, most, -(-len(own) // BLOCK))
        # The pivot of each block, commonest terms and then the shortest first; postings from there on, by term.
        often = np.array([found[w] for w in self.terms.tolist()] or [0])
        short = np.array([sizes[w] for w in self.terms.tolist()] or [0])
        order = np.lexsort((short[term], -often[term], block))
        block, term, most = block[order], term[order], most[order].astype(np.float64)
        upto = np.cumsum(most)
        begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        upto -= np.repeat(upto[begin] - most[begin], np.diff(np.append(begin, len(block))))
        late = upto >= self.threshold
        order = np.lexsort((block[late], term[late]))
        self.late_block = block[late][order]
        self.late_starts = np.searchsorted(term[late][order], np.arange(len(self.terms) + 1))

    @staticmethod
    def _postings(term: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> tuple[int, np.ndarray | None, np.ndarray, np.ndarray]:
        """Values by term * width + column: as a table where that is small, and as sorted keys."""
        keys = term * width + column
        order = np.argsort(keys)
        rows = int(term.max(initial=-1)) + 1
        dense = None
        if rows * width <= DENSE:
            dense = np.zeros(rows * width, np.float32)
            dense[keys] = value
        return width, dense, keys[order], value[order]

    @staticmethod
    def _sum(postings: tuple, terms: np.ndarray, counts: np.ndarray, begins: np.ndarray, n: np.ndarray, column: np.ndarray) -> np.ndarray:
        """For each candidate (passage n, column) the sum of its values over the terms of the passage."""
        width, dense, keys, values = postings
        spread = counts[n]
        key = terms[B.ragged(begins[n], spread)] * width + np.repeat(column, spread)
        if dense is not None:
            got = dense[key]
        else:
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            got = np.where(keys[place] == key, values[place], np.float32(0))
        return np.add.reduceat(got, np.cumsum(spread) - spread, dtype=np.float64)

    def search(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all scores of at least the threshold; passage and term are distinct pairs sorted by passage."""
        none = np.zeros(0, np.int64)
        if not len(passage):
            return none, none, np.zeros(0)
        begins = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        counts = np.diff(np.append(begins, len(passage)))
        own = np.repeat(np.arange(len(begins)), counts)
        width = self.bounds[0]
        spread = self.late_starts[term + 1] - self.late_starts[term]
        some = spread > 0
        pairs = np.unique(np.repeat(own[some], spread[some]) * width + self.late_block[B.ragged(self.late_starts[term[some]], spread[some])])
        n, block = pairs // width, pairs % width
        if len(n):
            may = self._sum(self.bounds, term, counts, begins, n, block) >= self.threshold - 1e-5
            n, block = n[may], block[may]
        if not len(n):
            return none, none, np.zeros(0)
        in_block = np.minimum(BLOCK, len(self.ids) - block * BLOCK)
        n, item = np.repeat(n, in_block), B.ragged(block * BLOCK, in_block)
        score = self._sum(self.impacts, term, counts, begins, n, item)
        hit = score >= self.threshold - 1e-5
        return passage[begins[n[hit]]], item[hit], score[hit]

    def overlaps(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles that stand in the passage; a part of fewer words than a shingle counts whole."""
        out = []
        for part in self.parts[item]:
            if not len(part):
                out.append(1.0)
                continue
            size = min(SHINGLE, len(part))
            mine = np.unique(shingles(part, size))
            out.append(float(np.isin(mine, shingles(words, size)).mean()))
        return out[0], out[1]


def _hits(ix: Index, data: np.ndarray, at: np.ndarray, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item) of each confirmed hit, with its score and overlaps."""
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    unit = max(64, ix.longest)
    h, row, _ = word_hashes(data, at)
    if not len(h) or not len(ix.terms):
        return out
    n = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(n) - n
    units = np.maximum(1, -(-n // unit))
    base = np.cumsum(units) - units
    of_unit = base[row] + (np.arange(len(h)) - first[row]) // unit
    place = np.minimum(np.searchsorted(ix.terms, h), len(ix.terms) - 1)
    known = ix.terms[place] == h
    pairs = np.unique(of_unit[known] * len(ix.terms) + place[known])
    u = pairs // len(ix.terms)
    # Passage u is units u and u + 1 of one text.
    before = u > np.repeat(base, units)[u]
    both = np.unique(np.concatenate([pairs, pairs[before] - len(ix.terms)]))
    passage, item, score = ix.search(both // len(ix.terms), both % len(ix.terms))
    text_of = np.repeat(np.arange(len(n)), units)
    for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist(), strict=True):
        r = int(text_of[p])
        begin = int(first[r]) + (p - int(base[r])) * unit
        q, a = ix.overlaps(i, h[begin : min(begin + 2 * unit, int(first[r] + n[r]))])
        if q >= overlap and a >= overlap:
            out[r, i] = max(out.get((r, i), (0.0, 0.0, 0.0)), (s, q, a))
    return out


def _search(docs: DataFrame, index: Index, overlap: float, key: str) -> DataFrame:
    """The column key of each text that holds an item, with the item and the scores."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = [key, "item_id", "score", "question_overlap", "answer_overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        for batch in batches:
            for f, _, data, at in B.chunks(*B.utf8(batch.column(1))):
                out = _hits(ix, data, at, overlap)
                if out:
                    rows = batch.column(0).take(pa.array([f + r for r, _ in out]))
                    items = ix.ids.take(pa.array([i for _, i in out]))
                    yield pa.RecordBatch.from_arrays([rows, items, *[pa.array([v[k] for v in out.values()]) for k in range(3)]], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(B.trimmed(run), f"`{key}` {kind}, item_id long, score double, question_overlap double, answer_overlap double")


def _without(docs: DataFrame, index: Index, overlap: float) -> DataFrame:
    """The rows of docs whose text holds no item."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, dtype=bool)
            for f, _, data, at in B.chunks(*B.utf8(batch.column(place))):
                stays[[f + r for r, _ in _hits(shared.value, data, at, overlap)]] = False
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(B.trimmed(run), docs.schema)


def _statistics(items: DataFrame) -> Callable[[int], tuple[int, float, dict[int, int]]]:
    """Of a block: items and mean length of the whole benchmark, and for the block's words in how many items of the whole they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, e, data, at in B.chunks(*B.utf8(batch.column(1))):
                h, row, _ = word_hashes(data, at)
                pairs = np.unique(np.rec.fromarrays([row, h], names="row,word")) if len(h) else np.rec.fromarrays([row, h], names="row,word")
                block = batch.column(0).slice(f, e - f).to_numpy(zero_copy_only=False)
                size = np.bincount(row, minlength=e - f)
                blocks = np.concatenate([block[pairs["row"]], block[size > 0]]).astype(np.int64)
                words = pa.array(np.concatenate([pairs["word"].view(np.int64), size[size > 0]]))
                yield pa.RecordBatch.from_arrays([pa.array(blocks), words, pa.array(np.arange(len(blocks)) >= len(pairs))], names=["block", "word", "length"])

    rows = cut(items.select("block", "text").mapInArrow(B.trimmed(run), "block long, word long, length boolean"), "item-words")
    n, size = rows.filter("length").agg(F.count("*"), F.coalesce(F.sum("word"), F.lit(0))).first()
    words = rows.filter("NOT length")
    known = cut(words.select("block", "word").distinct().join(words.groupBy("word").agg(F.count("*").alias("n")), "word"), "item-counts")
    return lambda b: (n, size / max(1, n), {r.word % (1 << 64): r.n for r in known.filter(F.col("block") == b).toLocalIterator()})


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator[tuple[int, Index]]:
    """How many blocks there are, and the index of each; one is held at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    rows, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if rows <= ITEMS_AT_ONCE and chars <= CHARS_AT_ONCE:
        yield 1, _index(items, threshold)
        return
    # Items fall by their place, not by what they say, into lots, and lots are put together up to the bounds.
    lots = 8 * max(1, -(-rows // ITEMS_AT_ONCE), -(-chars // CHARS_AT_ONCE))
    items = cut(items.withColumn("lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lots))), "items")
    block, n, size, of = 0, 0, 0, []
    for r in items.groupBy("lot").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).orderBy("lot").toLocalIterator():
        if n and (n + r.n > ITEMS_AT_ONCE or size + r.size > CHARS_AT_ONCE):
            block, n, size = block + 1, 0, 0
        n, size = n + r.n, size + r.size
        of.append((r.lot, block))
    table = items.sparkSession.createDataFrame(of, "lot long, block int")
    items = cut(items.join(table, "lot").select("item_id", "text", "block"), "items")
    own = _statistics(items)
    for b in range(block + 1):
        yield block + 1, _index(items.filter(F.col("block") == b), threshold, own(b))


def _index(items: DataFrame, threshold: float, whole: tuple[int, float, dict[int, int]] | None = None) -> Index:
    return Index([(r.item_id, r.text) for r in items.orderBy("item_id", "text").toLocalIterator()], threshold, whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.8, key: str = "doc_id") -> DataFrame:
    """doc_id (or another column, key), item_id, score, question_overlap and answer_overlap of each confirmed hit of a text and an item."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias(key) if key == "doc_id" else key, "text")
    out = None
    for blocks, index in _indexes(benchmark, threshold):
        found = _search(docs, index, overlap, key)
        found = found if blocks == 1 else cut(found, "hits")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.8) -> DataFrame:
    """docs without those that hold an item; all columns stay.

    With one block rows are judged where they are, without a shuffle. With several, rows go by the SHA-256 of their texts, on which alone
    a hit depends; hits are few, so they are what the join deals out.
    """
    ship(docs.sparkSession)
    rest = _indexes(benchmark, threshold)
    blocks, index = next(rest)
    if blocks == 1:
        return _without(docs, index, overlap)
    named = docs.select(F.sha2("text", 256).alias("text_sha256"), "text")
    hits = [cut(_search(named, ix, overlap, "text_sha256").select("text_sha256").distinct(), "hits") for ix in chain([index], (i for _, i in rest))]
    gone = hits[0]
    for more in hits[1:]:
        gone = gone.union(more)
    return docs.join(cut(gone.distinct(), "hits"), F.sha2(docs["text"], 256) == F.col("text_sha256"), "left_anti")
