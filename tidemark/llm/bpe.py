"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of ranks (base64 of the bytes, rank); its merges are found again from the ranks. The library works on
characters that stand for bytes; ids, character offsets and decoding go through that table. With the pattern SPACED, every match ends
before a space that a word follows, so texts are cut there and each run of one batch needs encoding once only; with another pattern a
text is one run.

Defined cases: a null text is encoded as the empty text, without tokens; null ids are decoded as none, to no bytes; ids that cut a character in two decode to the bytes
exactly, and to U+FFFD where text is asked for, unless the rest of the character follows (decode_stream); ids outside the vocabulary
are an error; repeated rows, ties and extra columns pass through untouched; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.bytesops import ragged, trimmed
from tidemark.plans.shipping import ship

#: Texts that are encoded between two looks at memory, in characters, and distinct runs a worker remembers.
BLOCK_CHARS = 1 << 21
REMEMBERED = 400_000
#: Runs that are encoded as one text.
JOINED = 512
#: Fixed value: the pattern of the public byte-level vocabularies.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that white space or nothing follows.
GAP = re.compile(r" (?:\s|$)")


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token was merged from: what merging by lower ranks alone leaves of it."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(q, i) for i in range(len(parts) - 1) if (q := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        self.pattern, self.ranks = pattern, read_ranks(path)
        ranks = self.ranks
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(x) for x in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._forget()

    @cached_property
    def tokenizer(self) -> object:
        """Made by the first text to encode; decoding doesn't need it."""
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        table = byte_table()
        written = lambda token: "".join([table[b] for b in token])
        merges = [(written(a), written(b)) for a, b in merges_of(self.ranks)]
        out = Tokenizer(models.BPE(vocab={written(k): v for k, v in self.ranks.items()}, merges=merges, ignore_merges=True))
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(self.pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def _forget(self) -> None:
        #: The number of each run that was encoded, and where its ids are in the pool.
        self.known: dict[str | tuple[str], int] = {}
        self.pool, self.begins, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, fresh: list[str | tuple[str]]) -> None:
        """Encodes new runs. Those after a space are encoded end to end, as one text: their bounds are bounds of tokens."""
        after = [x for x in fresh if type(x) is str]
        groups = [after[i : i + JOINED] for i in range(0, len(after), JOINED)] + [[x] for x in fresh if type(x) is tuple]
        pool, counts = [self.pool], [self.counts]
        for first in range(0, len(groups), 64):
            part = groups[first : first + 64]
            texts = [x[0][0] if type(x[0]) is tuple else " " + " ".join(x) for x in part]
            for group, found in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, dtype=np.int32)
                ends = np.array([len(ids)])
                if len(group) > 1:
                    sizes = np.fromiter(map(len, map(str.encode, group)), dtype=np.int64, count=len(group)) + 1
                    ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
                self.known.update(zip(group, range(len(self.known), len(self.known) + len(group)), strict=True))
                pool.append(ids)
                counts.append(np.diff(ends, prepend=0))
        self.pool, self.counts = np.concatenate(pool), np.concatenate(counts)
        self.begins = np.cumsum(self.counts) - self.counts

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) for blocks of whole texts."""
        runs: list[str | tuple[str]] = []
        counts: list[int] = []
        chars = 0

        def block() -> tuple[np.ndarray, np.ndarray]:
            if len(self.known) > REMEMBERED:
                self._forget()
            numbers = list(map(self.known.get, runs))
            if None in numbers:
                self._learn(list(dict.fromkeys([x for x, i in zip(runs, numbers, strict=True) if i is None])))
                numbers = list(map(self.known.get, runs))
            place = np.array(numbers, dtype=np.int64)
            each = self.counts[place]
            flat = self.pool[ragged(self.begins[place], each)]
            total = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(counts)
            return flat, total[ends] - total[ends - counts]

        for text in texts:
            found = split_runs(text or "") if self.pattern == SPACED else [(text,)] if text else []
            runs += found
            counts.append(len(found))
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield block()
                runs, counts, chars = [], [], 0
        if counts:
            yield block()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()

    def decode_stream(self, parts: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of ids that come in parts; a character that is cut at the end of a part is held for the next."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            yield held.decode(self.decode(part))
        yield held.decode(b"", final=True)

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each id, and the character after its last; an id that ends inside a character holds that character too."""
        ids = np.asarray(ids, dtype=np.int64)
        raw = np.frombuffer(self.decode(ids), dtype=np.uint8)
        begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[: len(raw)] = (raw & 0xC0) == 0x80
        return begun[starts] - inside[starts], begun[ends]


def split_runs(text: str) -> list[str | tuple[str]]:
    """Cuts at each space that a character other than white space follows. The first run is a tuple; the others leave that space out."""
    if not text:
        return []
    first, *rest = text.split(" ")
    if GAP.search(text) is None:
        return [(first,), *rest] if first else rest
    out = [first]
    for x in rest:
        if x and not x[0].isspace():
            out.append(x)
        else:
            out[-1] += " " + x
    return [(out[0],), *out[1:]] if out[0] else out[1:]


@cache
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBPE(path, pattern)


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*[f for f in df.schema.fields if f.name not in names], *fields])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True, offsets: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, and token_ids and token_starts and token_ends (characters) if asked for, to the columns `keep` (all by default)."""
    ship(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in {"n_tokens", "token_ids", "token_starts", "token_ends"}]
    ints = T.ArrayType(T.IntegerType(), False)
    more = [T.StructField("n_tokens", T.LongType(), False), *[T.StructField("token_ids", ints)] * ids, *[T.StructField(x, ints) for x in ("token_starts", "token_ends") if offsets]]
    schema = _with(df.select(*keep), *more)
    own = df.select(*[df[c] for c in keep], df[text].alias("text_to_encode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts, done = batch.column(len(keep)), 0
            for flat, counts in bpe.encode(x.as_py() for x in texts):
                at = np.concatenate([[0], np.cumsum(counts)])
                columns = [batch.column(i).slice(done, len(counts)) for i in range(len(keep))] + [pa.array(counts, pa.int64())]
                as_lists = lambda values, at=at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
                if ids:
                    columns.append(as_lists(flat))
                if offsets:
                    spans = [bpe.offsets(flat[at[i] : at[i + 1]]) for i in range(len(counts))]
                    columns += [as_lists(np.concatenate([s[k] for s in spans])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
                done += len(counts)
        bpe._forget()

    return own.mapInArrow(trimmed(run), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", text: bool = False, digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Adds decoded (the bytes), or decoded_text with `text`; with `digest` only ids_sha256 and decoded_sha256, so that no bytes travel."""
    ship(df.sparkSession)
    new = ["ids_sha256", "decoded_sha256"] if digest else ["decoded_text" if text else "decoded"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    kind = T.StringType() if digest or text else T.BinaryType()
    schema = _with(df.select(*keep), *[T.StructField(x, kind) for x in new])
    own = df.select(*[df[c] for c in keep], df[ids].alias("ids_to_decode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            lists = batch.column(len(keep))
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            columns = [[] for _ in new]
            for i in range(len(lists)):
                own_ids = flat[at[i] : at[i + 1]]
                raw = bpe.decode(own_ids)
                if digest:
                    columns[0].append(hashlib.sha256(own_ids.astype("<u4").tobytes()).hexdigest())
                    columns[1].append(hashlib.sha256(raw).hexdigest())
                else:
                    columns[0].append(raw.decode("utf-8", "replace") if text else raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, pa.string() if digest or text else pa.binary()) for c in columns]], names=schema.fieldNames())

    return own.mapInArrow(trimmed(run), schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, token_ids if asked for, ids_sha256 and decoded_sha256: each text is encoded and its ids are decoded again.

    As encode and decode, but in one worker, between which no ids travel.
    """
    ship(df.sparkSession)
    new = ["n_tokens", *["token_ids"] * ids, "ids_sha256", "decoded_sha256"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    kinds = [T.LongType(), *[T.ArrayType(T.IntegerType(), False)] * ids, T.StringType(), T.StringType()]
    schema = _with(df.select(*keep), *[T.StructField(n, k) for n, k in zip(new, kinds, strict=True)])
    own = df.select(*[df[c] for c in keep], df[text].alias("text_to_encode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts, done = batch.column(len(keep)), 0
            for flat, counts in bpe.encode(x.as_py() for x in texts):
                at = np.concatenate([[0], np.cumsum(counts)])
                parts = [flat[f:e] for f, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [batch.column(i).slice(done, len(counts)) for i in range(len(keep))] + [pa.array(counts, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())))
                columns.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in parts], pa.string()))
                columns.append(pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in parts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
                done += len(counts)
        bpe._forget()

    return own.mapInArrow(trimmed(run), schema)
