"""Removal of byte strings that repeat across documents, by hash-compared suffix sort of sampled suffixes.

Every string of `span` bytes has an anchor: the leftmost smallest hash among its grams of GRAM bytes. Equal strings have equal
anchors at equal places, so only suffixes at anchors (about one byte in 17) need comparing. A segment is all strings of one text
with the same anchor.

1. Within a batch of texts, segments found whole in a document with a smaller id are removed at once, compared byte by byte; what
   stands in a third of all documents leaves a batch once. The rest travels packed, dealt out by the anchor's hash. Grams in one
   document alone drop out. A segment whose hash a document with a smaller id has is to be removed with that one; segments that share
   only the anchor with others are asked for.
2. At the documents, bytes asked for are fetched, and segments to be removed are joined to runs whose SHA-256 goes to the text they are
   to be removed from. A run whose bytes there have another digest stays.
3. Suffixes of what was fetched are sorted in each block: a mergesort whose comparisons find common extensions by binary
   search over prefix polynomial hashes, so that a comparison costs the logarithm of the length. Neighbours with a common extension
   are compared byte by byte; where hashes have collided, the block is sorted by bytes instead. Strings equal to the right and to
   the left of the anchor form a class; its smallest doc_id keeps the string.
4. An anchor with more than BLOCK segments is dealt out in blocks; each block passes on one string a class, and the smallest doc_id
   of those is found by an aggregate over the strings themselves that counts before its shuffle.
5. Removed ranges travel packed to their documents. There are as many parts as hold PART bytes of text, and no fewer than the session's
   shuffle partitions; a task holds one part at a time.

So no byte goes by a hash alone but SHA-256. Where two different segments agree in the 48 and 32 bits that travel, the one whose run is
refused keeps its bytes even if a third document has them: a chance under 2**-40 for a part's segments.

Defined cases: a null text counts as empty; texts under `span` bytes are kept whole; a null doc_id is smaller and greater than none:
that row is kept whole and removes nothing; rows with the same doc_id don't remove from each other, each is cut by its own text;
strings are judged on the input; matches never cross documents; an empty table gives no rows; extra columns are passed on.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bytesops as B
from tidemark.llm.runtime import cut, partitions
from tidemark.plans.shipping import ship

GRAM, BLOCK = 18, 4096
#: Suffixes that are sorted together.
WORK = 20_000
#: Bytes of text whose segments are packed together.
PACKED = 1 << 24
#: Bytes of text to a part.
PART = 1 << 25
#: Bytes of an anchor's hash and of a whole segment's that travel.
GRAM_BYTES, WHOLE_BYTES = 4, 6


def anchors(data: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """row, first string, last string, anchor, hash of the anchor's gram and of the whole segment, for each segment."""
    n, strings = len(data), len(data) - span + 1
    none = np.zeros(0, np.int64)
    if strings <= 0:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = B.prefix_hashes(data)
    down = B.powers(n + 1)[1]
    grams = B.mix((prefix[GRAM:] - prefix[: n - GRAM + 1]) * down[: n - GRAM + 1])
    width, best, where, done = span - GRAM + 1, grams, np.arange(len(grams), dtype=np.int32), 1
    while done < width:
        step = min(done, width - done)
        later = best[step:] < best[: len(best) - step]
        where = np.where(later, where[step:], where[: len(where) - step])
        best = np.where(later, best[step:], best[: len(best) - step])
        done += step
    inside = np.zeros(strings, dtype=bool)
    long = np.flatnonzero(np.diff(at) >= span)
    mark = np.zeros(strings + 1, dtype=np.int32)
    np.add.at(mark, at[long], 1)
    np.add.at(mark, at[long + 1] - span + 1, -1)
    inside = np.cumsum(mark[:-1]) > 0
    change = np.ones(strings, dtype=bool)
    change[1:] = (where[1:] != where[:-1]) | ~inside[:-1]
    begins = np.zeros(strings, dtype=bool)
    begins[at[long]] = True
    first = np.flatnonzero(inside & (change | begins))
    ends = np.ones(strings, dtype=bool)
    ends[:-1] = (where[1:] != where[:-1]) | ~inside[1:] | begins[1:]
    last = np.flatnonzero(inside & ends)
    anchor = where[first].astype(np.int64)
    whole = B.span_hashes(prefix, first, last + span)
    whole = B.mix(whole + (anchor - first).astype(np.uint64) * np.uint64(B.BASE) + (last - first).astype(np.uint64))
    return np.searchsorted(at, first, side="right") - 1, first, last, anchor, grams[anchor], whole


def _small(values: np.ndarray) -> np.ndarray:
    """As two bytes each if they fit, else eight."""
    return values.astype(np.uint16) if not len(values) or values.max() < 65536 else values.astype(np.uint64)


def _large(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint64).astype(np.int64)


def _tags(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each whole text: rows of one doc_id are told apart by it."""
    return (B.span_hashes(B.prefix_hashes(data), at[:-1], at[1:]) ^ np.diff(at).astype(np.uint64)).view(np.int64)


def _named(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id of each row, and which rows have one."""
    return np.asarray(batch.column(0).fill_null(0), dtype=np.int64), np.asarray(batch.column(0).is_valid())


SEGMENTS = "p int, ids binary, tags binary, counts binary, first binary, meta binary, gram binary, whole binary, rows binary"


def _low(values: np.ndarray, size: int) -> bytes:
    """The lowest bytes of 64-bit words."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _high(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw[a : a + size] and raw[b : b + size] are equal, some at a time."""
    out = np.ones(len(a), dtype=bool)
    each = max(1, (1 << 20) // max(1, int(size.max(initial=1))))
    for f in range(0, len(a), each):
        n = size[f : f + each]
        same = raw[B.ragged(a[f : f + each], n)] == raw[B.ragged(b[f : f + each], n)]
        out[f : f + each] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def _within(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which segments equal one of a smaller doc_id among them, byte by byte."""
    order = np.lexsort((doc, key))
    run = _runs(key[order])
    lead = order[np.flatnonzero(np.append(True, run[1:] != run[:-1]))][run] if len(order) else order
    may = (doc[order] > doc[lead]) & (size[order] == size[lead])
    i, j = order[may], lead[may]
    gone = np.zeros(len(doc), dtype=bool)
    gone[i] = _equal(raw, at[row[i]] + first[i], at[row[j]] + first[j], size[i])
    return gone


def _joined(begin: np.ndarray, end: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the runs of rows with equal keys that overlap or touch, and where the runs end; rows are sorted by keys and begin."""
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    heads = np.flatnonzero(new)
    return heads, np.maximum.reduceat(end, heads) if len(heads) else end


def segments(docs: DataFrame, span: int, parts: int) -> DataFrame:
    """The segments of whole texts, packed by the part that their anchor's hash falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, places = B.utf8(batch.column(1))
            ids, named = _named(batch)
            for first_row, last_row, _, _ in B.chunks(raw, places, PACKED):
                own_at = places[first_row : last_row + 1]
                found = []
                for f, e, data, at in B.chunks(raw, own_at):
                    row, first, last, anchor, gram, whole = anchors(data, at, span)
                    keep = named[first_row + f : first_row + e][row]
                    found.append([x[keep] for x in (row + f, first - at[row], last - first, anchor - first, gram, whole)] + [_tags(data, at)])
                row, first, length, off, gram, whole, tags = (np.concatenate(x) for x in zip(*found, strict=True))
                doc_ids = ids[first_row:last_row]
                gone = _within(raw, own_at, doc_ids[row], row, first, length + span, B.mix(whole + gram * np.uint64(B.BASE)))
                heads, ends = _joined(first[gone], first[gone] + length[gone] + span, row[gone])
                r = row[gone][heads]
                done = _by_doc(parts, 0, doc_ids[r], tags[r], first[gone][heads], ends)
                out = [(q, *[None] * 7, rows) for q, rows in zip(done.column("q").to_pylist(), done.column("rows").to_pylist(), strict=True)]
                row, first, length, off, gram, whole = (x[~gone] for x in (row, first, length, off, gram, whole))
                part = (gram % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                gram = gram // np.uint64(parts)
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    o = order[cuts[p] : cuts[p + 1]]
                    r = row[o]
                    begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                    own, delta = r[begin], np.diff(first[o], prepend=0)
                    delta[begin] = first[o][begin]
                    meta = np.stack([off[o], length[o]]).astype(np.uint8)
                    out.append((p, doc_ids[own].tobytes(), tags[own].tobytes(), np.diff(np.append(begin, len(o))).astype(np.uint32).tobytes(), _small(delta).tobytes(), meta.tobytes(), _low(gram[o], GRAM_BYTES), _low(whole[o], WHOLE_BYTES), None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], names=SEGMENTS.replace(" binary", "").replace(" int", "").split(", "))

    return docs.select("doc_id", "text").mapInArrow(B.trimmed(run), SEGMENTS)


def _unpack(t: pa.Table) -> tuple[np.ndarray, ...]:
    """doc_id, tag, first string, anchor - first, last - first, gram and whole of all segments in a packed table."""
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    for r in t.to_pylist():
        counts = np.frombuffer(r["counts"], np.uint32).astype(np.int64)
        n, begin = int(counts.sum()), np.cumsum(counts) - counts
        first = np.cumsum(_large(r["first"], n))
        first -= np.repeat(first[begin] - _large(r["first"], n)[begin], counts)
        meta = np.frombuffer(r["meta"], np.uint8).reshape(2, n)
        row = (np.repeat(np.frombuffer(r["ids"], np.int64), counts), np.repeat(np.frombuffer(r["tags"], np.int64), counts), first, meta[0], meta[1], _high(r["gram"], GRAM_BYTES), _high(r["whole"], WHOLE_BYTES))
        for o, x in zip(out, row, strict=True):
            o.append(x)
    return tuple(np.concatenate(x) for x in out)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """The number of the run that each row is in, for rows sorted by the keys."""
    edge = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        edge[1:] |= k[1:] != k[:-1]
    return np.cumsum(edge)


def _by_doc(parts: int, kind: int, doc: np.ndarray, tag: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """Rows packed by the part their document falls in: ranges to remove (kind 0), segments asked for (kind 1), segments to remove with their sources (2), runs with digests (3)."""
    q = (B.mix(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(q, kind="stable")
    cuts = np.searchsorted(q[order], np.arange(parts + 1))
    rows = [(p, kind, np.stack([x[order[cuts[p] : cuts[p + 1]]].astype(np.int64) for x in (doc, tag, *more)]).tobytes()) for p in np.flatnonzero(np.diff(cuts)).tolist()]
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["q", "kind", "rows"])


def resolve(packed: DataFrame, span: int, parts: int, most: int = BLOCK) -> DataFrame:
    """Segments that whole segments with smaller ids remove, by those, and the segments whose bytes are needed; packed by document."""

    def run(t: pa.Table) -> pa.Table:
        ready = t.filter(pc.is_valid(t.column("rows")))
        out = [pa.RecordBatch.from_arrays([ready.column("p").combine_chunks(), pa.array(np.zeros(ready.num_rows, np.int32)), ready.column("rows").combine_chunks()], names=["q", "kind", "rows"])]
        t = t.filter(pc.is_null(t.column("rows")))
        if not t.num_rows:
            return pa.Table.from_batches(out)
        doc, tag, first, off, length, gram, whole = _unpack(t)
        order = np.lexsort((doc, whole, gram))
        doc, tag, first, off, length, gram, whole = (x[order] for x in (doc, tag, first, off, length, gram, whole))
        group = _runs(gram)
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        shared = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
        keep = shared[group]
        doc, tag, first, off, length, gram, whole = (x[keep] for x in (doc, tag, first, off, length, gram, whole))
        if not len(doc):
            return pa.Table.from_batches(out)
        same = _runs(gram, whole)
        lead = np.flatnonzero(np.append(True, same[1:] != same[:-1]))[same]
        gone = (doc > doc[lead]) & (length == length[lead])
        source = lead[gone]
        out.append(_by_doc(parts, 2, doc[source], tag[source], first[source], doc[gone], tag[gone], first[gone], length[gone].astype(np.int64) + span))
        # What is left of each gram, if documents differ still: one segment of a kind, or that document's repeats of it.
        left = ~gone
        doc, tag, first, off, length, gram = (x[left] for x in (doc, tag, first, off, length, gram))
        group = _runs(gram)
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ask = (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin))[group]
        size = np.diff(np.append(begin, len(gram)))[group]
        blocks = -(-size // most)
        salt = np.where(blocks > 1, (B.mix(doc.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64) + 1, 0)
        out.append(_by_doc(parts, 1, *(x[ask] for x in (doc, tag, first, off, length, gram, salt))))
        return pa.Table.from_batches(out)

    return packed.groupBy("p").applyInArrow(B.trimmed_group(run), "q int, kind int, rows binary")


def _texts(docs: DataFrame, parts: int, *more: str) -> DataFrame:
    """doc_id, text and more of many rows as one compressed Arrow stream, with the part q that _by_doc gives the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            ids, named = _named(batch)
            q = np.where(named, (B.mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64), np.arange(len(ids)) % parts)
            order = np.argsort(q, kind="stable")
            cuts = np.searchsorted(q[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.take(pa.array(order[cuts[p] : cuts[p + 1]])))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["q", "stream"])

    return docs.select("doc_id", "text", *more).mapInArrow(B.trimmed(run), "q int, stream binary")


def _unpacked(t: pa.Table) -> pa.Table:
    """The rows that _texts packed."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in t.column("stream").to_pylist()])


def _rows_of(t: pa.Table, kind: int, width: int) -> np.ndarray:
    found = [np.frombuffer(r, np.int64).reshape(width, -1) for r, k in zip(t.column("rows").to_pylist(), t.column("kind").to_pylist(), strict=True) if k == kind]
    return np.concatenate(found, axis=1) if found else np.zeros((width, 0), np.int64)


def _place(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the rows (doc, tag) the text it belongs to, and the texts in an order by document."""
    order = np.lexsort((tags, ids))
    pairs = np.empty(len(ids), dtype=[("d", np.int64), ("t", np.int64)])
    pairs["d"], pairs["t"] = ids[order], tags[order]
    asked = np.empty(len(doc), dtype=pairs.dtype)
    asked["d"], asked["t"] = doc, tag
    return np.searchsorted(pairs, asked), order


def fetch(asked: DataFrame, docs: DataFrame, span: int, parts: int) -> DataFrame:
    """The bytes of the segments asked for: gram, salt, doc, tag, first, off, length and bytes."""
    names = ["gram", "salt", "doc", "tag", "first", "off", "length", "bytes"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, sources = _rows_of(right, 1, 7), _rows_of(right, 2, 7)
        if not rows.shape[1] + sources.shape[1] or not left.num_rows:
            return pa.table([pa.array([], pa.binary() if n == "bytes" else pa.int64()) for n in names], names=names)
        left = _unpacked(left)
        raw, at = B.utf8(left.column("text"))
        ids = np.asarray(left.column("doc_id").combine_chunks().fill_null(0), dtype=np.int64)
        tags = np.concatenate([_tags(data, a) for _, _, data, a in B.chunks(raw, at)])
        doc, tag, first, off, length, gram, salt = rows
        place, order = _place(ids, tags, doc, tag)
        start = at[order[place]] + first
        size = length + span
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        data = raw[B.ragged(start, size)]
        blobs = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        asked = pa.table([*[pa.array(x) for x in (gram, salt, doc, tag, first, off, length)], blobs], names=names)
        # Segments of one source and one target, at the same distance, as runs with digests, for the targets.
        doc, tag, first, to, to_tag, to_first, size = sources
        place, _ = _place(ids, tags, doc, tag)
        apart = to_first - first
        by = np.lexsort((first, apart, to_tag, to, place))
        place, first, to, to_tag, apart, size = (x[by] for x in (place, first, to, to_tag, apart, size))
        heads, ends = _joined(first, first + size, place, to, to_tag, apart)
        begin = at[order[place[heads]]]
        digests = _digests(raw, begin + first[heads], begin + ends)
        runs = _by_doc(parts, 3, to[heads], to_tag[heads], first[heads] + apart[heads], ends + apart[heads], *digests)
        q = runs.column("q").cast(pa.int64())
        none = pa.array(np.zeros(len(q), np.int64))
        return pa.concat_tables([asked, pa.table([q, pa.array(np.full(len(q), DIGESTS)), q, none, none, none, none, runs.column("rows")], names=names)])

    texts = _texts(docs, parts)
    return texts.groupBy("q").cogroup(asked.filter("kind IN (1, 2)").groupBy("q")).applyInArrow(B.trimmed_group(run), ", ".join(f"{n} {'binary' if n == 'bytes' else 'long'}" for n in names))


#: A salt that marks rows of digests on their way to the texts.
DIGESTS = -1


def _digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SHA-256 of raw[begin:end] for each pair, as four rows of 64-bit words."""
    out = b"".join([hashlib.sha256(raw[b:e]).digest() for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 4).T


class Suffixes:
    """Suffixes of a byte array, each with its own end, that compare by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.data, self.start, self.length = data, start, end - start
        self.prefix = B.prefix_hashes(data)
        self.down = B.powers(len(data) + 1)[1]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes x and y: binary search for the longest equal prefix hashes."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        pa_, pb, da, db = self.prefix[a], self.prefix[b], self.down[a], self.down[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) // 2
            equal = (self.prefix[a + mid] - pa_) * da == (self.prefix[b + mid] - pb) * db
            low, high = np.where(equal, mid, low), np.where(equal, high, np.maximum(mid - 1, low))
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix x is smaller than y, and whether they are equal."""
        n = self.common(x, y)
        ended_x, ended_y = n >= self.length[x], n >= self.length[y]
        top = len(self.data) - 1
        byte_x, byte_y = self.data[np.minimum(self.start[x] + n, top)], self.data[np.minimum(self.start[y] + n, top)]
        return np.where(ended_x | ended_y, ended_x & ~ended_y, byte_x < byte_y), ended_x & ended_y

    def sort(self) -> np.ndarray:
        """Mergesort, all merges of a level at once: each suffix finds by binary search how many of the other run come before it."""
        n = len(self.start)
        order, width, place = np.arange(n), 1, np.arange(n)
        while width < n:
            block, within = place // width, place % width
            other = (block ^ 1) * width
            size = np.clip(n - other, 0, width)
            low, high = np.zeros(n, np.int64), size.copy()
            right = (block & 1).astype(bool)
            for _ in range(int(width).bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                less, equal = self.before(order[other[open_] + mid], order[open_])
                up = less | (equal & right[open_])
                low[open_[up]], high[open_[~up]] = mid[up] + 1, mid[~up]
            target = (block & ~1) * width + within + low
            merged = np.empty(n, order.dtype)
            merged[target] = order
            order, width = merged, 2 * width
        return order


def sorted_suffixes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and what each has in common with the one before it; checked byte by byte, and sorted by bytes if hashes collided."""
    s = Suffixes(data, start, end)
    order = s.sort()
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        x, y = order[:-1], order[1:]
        common[1:] = s.common(x, y)
        equal = data[B.ragged(start[x], common[1:])] == data[B.ragged(start[y], common[1:])]
        a, b = start[x] + common[1:], start[y] + common[1:]
        more = (a < end[x]) & (b < end[y])
        if not equal.all() or (data[a[more]] >= data[b[more]]).any():
            order = np.array(sorted(range(len(start)), key=lambda i: data[start[i] : end[i]].tobytes()), dtype=np.int64)
            for k, (i, j) in enumerate(zip(order[:-1], order[1:], strict=True), 1):
                n = min(end[i] - start[i], end[j] - start[j])
                differ = np.flatnonzero(data[start[i] : start[i] + n] != data[start[j] : start[j] + n])
                common[k] = differ[0] if len(differ) else n
    return order, common


def _numbered(rows: np.ndarray) -> np.ndarray:
    """A number for each row, equal where the rows are."""
    return np.unique(rows, axis=0, return_inverse=True)[1].ravel()


FOUND = "q int, kind int, rows binary, string binary, doc long, tag long, first long"


def compare(fetched: DataFrame, span: int, parts: int, most: int = WORK) -> DataFrame:
    """Sorts the suffixes at the anchors of each part; gives ranges to remove, and for blocks of large groups one string a class."""

    fields = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
        if not (held and sum(b.num_rows for b in held)):
            return
        t = pa.Table.from_batches(held)
        ready = pc.equal(t.column("salt"), DIGESTS)
        for b in t.filter(ready).to_batches():
            blank = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc").cast(pa.int32()), pa.array(np.full(b.num_rows, 3, np.int32)), b.column("bytes"), blank.cast(pa.binary()), *[blank.cast(pa.int64())] * 3], names=fields)
        t = t.filter(pc.invert(ready))
        if not t.num_rows:
            return
        gram, salt, doc, tag, first, off, length = (t.column(i).to_numpy() for i in range(7))
        # Blocks that end between groups, so that memory holds one block's arrays.
        order = np.lexsort((salt, gram))
        group = _runs(gram[order], salt[order])
        edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        begin, texts = 0, t.column("bytes").combine_chunks()
        while begin < len(order):
            later = edges[edges >= begin + most]
            end = int(later[0]) if len(later) else len(order)
            o = order[begin:end]
            begin = end
            data, at = B.utf8(texts.take(pa.array(o)))
            d, g, s, a = doc[o], tag[o], salt[o], at[:-1] + off[o]
            by, common = sorted_suffixes(data, a, at[1:])
            prefix = B.prefix_hashes(data)
            gone_at, gone_row, reps = [], [], []
            for k in range(int(off[o].max(initial=0)) + 1):
                here = (k <= off[o][by]) & (k >= off[o][by] - length[o][by])
                if not here.any():
                    continue
                # Runs of suffixes that agree for span - k bytes, split by the k bytes before the anchor and by block.
                run_of = np.cumsum(common < span - k)
                i = by[here]
                left = data[B.ragged(a[i] - k, np.full(len(i), k))].reshape(len(i), k)  # the bytes before the anchor
                for exact in (False, True):
                    before = _numbered(left) if exact else B.span_hashes(prefix, a[i] - k, a[i])
                    keys = np.lexsort((d[i], s[i], before, run_of[here]))
                    r, h, block = run_of[here][keys], before[keys], s[i][keys]
                    klass = _runs(r, h, block)
                    lead = np.flatnonzero(np.append(True, klass[1:] != klass[:-1]))[klass]
                    # Compared as they are; where hashes have collided, classes are told by the bytes themselves.
                    if (left[keys] == left[keys][lead]).all():
                        break
                i, lead = i[keys], i[keys][lead]
                gone = d[i] > d[lead]
                gone_row.append(i[gone])
                gone_at.append(first[o][i[gone]] + off[o][i[gone]] - k)
                salted = i[~gone & (s[i] > 0)]
                if len(salted):
                    reps.append((salted, first[o][salted] + off[o][salted] - k, a[salted] - k))
            if gone_row:
                row, place = np.concatenate(gone_row), np.concatenate(gone_at)
                packed = _by_doc(parts, 0, d[row], g[row], place, place + span)
                blank = pa.nulls(packed.num_rows)
                yield pa.RecordBatch.from_arrays([*packed.columns, blank.cast(pa.binary()), *[blank.cast(pa.int64())] * 3], names=fields)
            for row, place, byte in reps:
                none = pa.nulls(len(row))
                strings = pa.array([data[b : b + span].tobytes() for b in byte.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary()), strings, *[pa.array(x) for x in (d[row], g[row], place)]], names=fields)

    return fetched.repartition(parts, "gram", "salt").mapInArrow(B.trimmed(run), FOUND)


def _packed_rows(rows: DataFrame, span: int, parts: int) -> DataFrame:
    """Rows of doc, tag and first as ranges packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag, first = (batch.column(i).to_numpy() for i in range(3))
            yield _by_doc(parts, 0, doc, tag, first, first + span)

    return rows.select("doc", "tag", "first").mapInArrow(B.trimmed(run), "q int, kind int, rows binary")


def removed(docs: DataFrame, span: int, parts: int, most: int = BLOCK) -> DataFrame:
    """Ranges of bytes to remove (kind 0), and runs to remove if their bytes have the digest (kind 3), packed by document; see the module."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = cut(resolve(segments(docs, span, parts), span, parts, most), "resolved")
    _release(docs)
    second = cut(compare(fetch(first, docs, span, parts), span, parts), "compared")
    _release(docs)
    reps = second.filter("string IS NOT NULL")
    least = reps.groupBy("string").agg(F.min("doc").alias("least"))
    third = _packed_rows(reps.join(least, "string").filter("doc > least"), span, parts)
    return first.filter("kind = 0").unionByName(second.filter("kind IN (0, 3)").select("q", "kind", "rows")).unionByName(third)


def parts_for(docs: DataFrame) -> int:
    """Parts to deal the texts out in, by their bytes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(partitions(docs.sparkSession), -(-size // PART))


def _release(df: DataFrame) -> None:
    """Lets Spark drop shuffle files that no table needs any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, span: int = 50, text: bool = True, digest: bool = False, most: int = BLOCK) -> DataFrame:
    """docs with kept (bytes that remain), n_bytes, n_removed, n_spans and, if `text`, text cut to what remains.

    With `digest`, kept_sha256 stands in for the bytes. Where a cut falls inside a character, its loose bytes go from the text (not
    from kept).
    """
    ship(docs.sparkSession)
    parts = parts_for(docs)
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()) if digest else T.StructField("kept", T.BinaryType())]
    own = [c for c in docs.columns if c not in {f.name for f in new} | {"doc_id", "text"}]
    ranges = removed(docs, span, parts, most)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = _texts(docs, parts, *own)
    fields = [f for f in docs.select("doc_id", "text", *own).schema.fields if text or f.name != "text"]
    schema = T.StructType([*fields, *new])

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in types], names=schema.fieldNames())
        left = _unpacked(left)
        sure, runs = _rows_of(right, 0, 4), _rows_of(right, 3, 8)
        raw, at = B.utf8(left.column("text"))
        ids = np.asarray(left.column("doc_id").combine_chunks().fill_null(0), dtype=np.int64)
        named = np.asarray(left.column("doc_id").combine_chunks().is_valid())
        tags = np.concatenate([_tags(data, a) for _, _, data, a in B.chunks(raw, at)])
        place, order = _place(ids, tags, *runs[:2])
        own = at[order[place]]
        same = (_digests(raw, own + runs[2], own + runs[3]) == runs[4:]).all(axis=0)
        doc, tag, begin, end = np.concatenate([sure, runs[:4, same]], axis=1)
        place, order = _place(ids, tags, doc, tag)
        by = np.argsort(place, kind="stable")
        place, begin, end = place[by], begin[by], end[by]
        columns: list[list] = [[], [], [], [], []]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # Equal rows (same doc_id and text) share the place of the first of them.
        pairs = np.stack([ids[order], tags[order]])
        lead = np.arange(len(order))
        same = np.append(False, (pairs[:, 1:] == pairs[:, :-1]).all(axis=0)) if len(order) else np.zeros(0, bool)
        lead[same] = 0
        lead = np.maximum.accumulate(lead)
        starts, ends_ = np.searchsorted(place, lead[rank]), np.searchsorted(place, lead[rank], side="right")
        for i in range(len(ids)):
            data = raw[at[i] : at[i + 1]]
            f, e = int(starts[i]), int(ends_[i])
            n_removed = n_spans = 0
            kept = data
            if e > f and named[i]:
                cover = np.zeros(len(data) + 1, np.int32)
                np.add.at(cover, begin[f:e], 1)
                np.add.at(cover, end[f:e], -1)
                gone = np.cumsum(cover[:-1]) > 0
                n_removed, n_spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = data[~gone]
            kept = kept.tobytes()
            for c, v in zip(columns, (kept.decode("utf-8", "ignore") if text else None, len(data), n_removed, n_spans, hashlib.sha256(kept).hexdigest() if digest else kept), strict=True):
                c.append(v)
        out = [pa.array(columns[0], pa.string()) if f.name == "text" else left.column(f.name) for f in fields]
        return pa.table([*out, *[pa.array(c, t) for c, t in zip(columns[1:], types[len(fields) :], strict=True)]], names=schema.fieldNames())

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema.fields]
    return texts.groupBy("q").cogroup(ranges.groupBy("q")).applyInArrow(B.trimmed_group(run), schema)
