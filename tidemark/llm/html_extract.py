"""HTML extraction: a recurrent block labeller over the leaf sequence of a page.

A page is parsed into blocks: runs of text between tags that aren't inline, each in a tree of the tags it stands in, with class, id,
role and itemprop words. Scripts, styles, templates, frames' stand-ins and comments aren't text; everything else is. A bidirectional
LSTM (numpy) reads a vector for each block - hashed tags and names of its path, hashed words, measures of the block and of the parts of
the page it stands in, and how far its path agrees with its neighbours' - and labels every block as main text or not with the whole
page as context. It is trained, once a driver, on pages that html_layouts makes in eight families of layouts.

Defined cases: a null or empty html gives an empty text; a page none of whose blocks reaches ENOUGH gives its blocks from LEAST on, the
labeller's best guess, and an empty text only where there are none of these; broken markup is read as far as it goes (open tags close
with their parent, an end tag without a start is passed over); very long and deeply nested pages are labelled whole, in time that grows
with their length; repeated rows are labelled each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.bytesops import trimmed
from tidemark.llm.html_layouts import FAMILIES, MARK, made_page
from tidemark.plans.shipping import ship

#: Buckets of a path's tags and names, buckets of words, measures of a block, ancestors that are measured, and the network's widths.
PATHS, WORDS, MEASURES, UP, INNER, HIDDEN = 192, 64, 17, 4, 40, 28
WIDE = PATHS + WORDS + MEASURES + 4 * UP
#: A block is main text from this chance on; where none is, from LEAST on.
ENOUGH, LEAST = 0.4, 0.15
#: Blocks that are labelled at once, padding included.
AT_ONCE = 20_000
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow msub msup q s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset("script style template iframe".split())
#: What an opening tag closes, if it is open: itself and its likes.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"}
#: Where the search for a tag to close ends.
SCOPE = frozenset("ul ol dl table article section div main nav aside form body".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_PART = re.compile(r"[a-z]+")


def _bit(word: str) -> int:
    return 1 << zlib.crc32(word.encode("utf-8", "replace")) % PATHS


@cache
def _tag_bits(tag: str, outer: str) -> tuple[int, int]:
    """Bits that a tag adds to its path, and those of a block that stands in it."""
    return _bit(f"<{tag}"), _bit(f"@{tag}") | _bit(f"{outer}/{tag}")


class Node:
    """A tag that isn't inline; what is in it is added up when it closes."""

    __slots__ = ("above", "tag", "depth", "bits", "inner", "chars", "linked", "stops", "blocks", "first", "prose", "texts")

    def __init__(self, above: Node | None, tag: str, names: str, first: int = 0) -> None:
        own, self.inner = _tag_bits(tag, above.tag if above else "")
        for w in _PART.findall(names.lower()) if names else ():
            own |= _bit(f".{w}")
        self.above, self.tag = above, tag
        self.depth, self.bits = (above.depth + 1, above.bits | own) if above else (0, own)
        self.chars = self.linked = self.stops = self.blocks = self.prose = self.texts = 0
        self.first = first


class Blocks(HTMLParser):
    """Collects (node, text, link characters, ends of sentences, depth that its path shares with the block before) of each block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node(None, "", "")
        self.stack: list[tuple[str, Node]] = []
        self.found: list[tuple[Node, str, int, int, int]] = []
        self.text: list[str] = []
        self.open: dict[str, int] = {}
        self.linked = self.unread = self.links = self.shared = 0

    def node(self) -> Node:
        return self.stack[-1][1] if self.stack else self.top

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                n = self.node()
                stops = text.count(".") + text.count("!") + text.count("?")
                n.chars, n.linked, n.stops, n.blocks = n.chars + len(text), n.linked + self.linked, n.stops + stops, n.blocks + 1
                # Text counts for the tag around its own; the second text right in a tag and those after it for that tag.
                part = n if n.texts or not n.above else n.above
                part.prose += len(text) - self.linked
                n.texts += 1
                self.found.append((n, text, self.linked, stops, min(self.shared, n.depth)))
                self.shared = n.depth
            self.text, self.linked = [], 0

    def pop(self) -> None:
        tag, n = self.stack.pop()
        self.open[tag] -= 1
        self.unread -= tag in UNREAD
        self.links -= tag == "a"
        if n is not self.node():
            up = n.above
            up.chars, up.linked, up.stops, up.blocks = up.chars + n.chars, up.linked + n.linked, up.stops + n.stops, up.blocks + n.blocks
            self.shared = min(self.shared, up.depth)

    def close_back(self, names: frozenset[str] | set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in SCOPE:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag not in INLINE
        if block:
            self.flush()
            if tag in ENDS_P:
                self.close_back({"p"})
            if tag in CLOSES:
                self.close_back(set(CLOSES[tag].split()))
        if tag not in VOID:
            above = self.node()
            self.stack.append((tag, Node(above, tag, " ".join([v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v]), len(self.found)) if block else above))
            self.open[tag] = self.open.get(tag, 0) + 1
            self.unread += tag in UNREAD
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.open.get(tag):
            while self.stack:
                found = self.stack[-1][0] == tag
                self.pop()
                if found:
                    return

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[tuple[Node, str, int, int, int]]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    while parser.stack:
        parser.pop()
    return parser.found


def vectors(found: list[tuple[Node, str, int, int, int]]) -> np.ndarray:
    """One vector for each block of a page."""
    n = len(found)
    out = np.zeros((n, WIDE), np.float32)
    if not n:
        return out
    bits = b"".join([(b[0].bits | b[0].inner).to_bytes(PATHS // 8, "little") for b in found])
    out[:, :PATHS] = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(n, -1), axis=1, bitorder="little")
    known: dict[str, int] = {}
    hashed: list[int] = []
    sizes: list[int] = []  # of each block and the tags around it: characters, of these in links, ends of sentences, blocks
    rows = []
    whole = sum(len(b[1]) for b in found)
    # The tag with the most text outside links in blocks right under it, and where its blocks begin and end.
    home = max((x for b in found for x in (b[0].above, b[0]) if x), key=lambda x: x.prose)
    begin, end = home.first, home.first + home.blocks
    for i, (node, text, linked, stops, shared) in enumerate(found):
        words = text.lower().split()
        hashed += [i * WORDS + (known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode("utf-8", "replace")) % WORDS)) for w in words]
        sizes += (len(text), linked, stops, 1)
        up: Node = node
        for _ in range(UP):
            sizes += (up.chars, up.linked, up.stops, up.blocks)
            up = up.above or up
        after = found[i + 1][4] if i + 1 < n else 0
        sample = text[:120]
        letters = sum(map(str.isalpha, sample))
        rows.append((len(words), len(words[-1]), node.depth, shared, after, text[-1] in ".!?", text[-1] in ",:;", letters / len(sample), sum(map(str.isupper, sample)) / max(1, letters), (i + 0.5) / n, i, n - i, text[0].isdigit(), len(text), begin <= i < end, node.above is home or node is home, i >= end))
    out[:, PATHS : PATHS + WORDS] = np.sqrt(np.bincount(hashed, minlength=n * WORDS).reshape(n, WORDS) / np.array([r[0] for r in rows])[:, None])
    m = np.array(rows, dtype=np.float64)
    depth = np.maximum(m[:, 2], 1)
    out[:, PATHS + WORDS : PATHS + WORDS + MEASURES] = np.stack([
        np.log1p(m[:, 0]) / 5, np.minimum(m[:, 1], 20) / 20, np.minimum(m[:, 2], 30) / 10, m[:, 3] / depth, m[:, 4] / depth, m[:, 5], m[:, 6], m[:, 7], m[:, 8], m[:, 9],
        np.exp(-m[:, 10] / 4), np.exp(-m[:, 11] / 4), m[:, 12], np.log1p(m[:, 13]) / 6, m[:, 14], m[:, 15], m[:, 16],
    ], axis=1)
    around = np.array(sizes, dtype=np.float64).reshape(n, UP + 1, 4)
    chars = np.maximum(around[:, :, 0], 1)
    own = np.stack([np.log1p(around[:, 1:, 0]) / 8, (around[:, :, 1] / chars)[:, :UP], np.minimum(1.5, 20 * around[:, :, 2] / chars)[:, :UP], (around[:, :, 0] / whole)[:, 1:]], axis=2)
    out[:, PATHS + WORDS + MEASURES :] = own.reshape(n, -1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, m: dict[str, np.ndarray], d: str) -> dict[str, np.ndarray]:
    steps, n, _ = x.shape
    ahead = x @ m[f"X{d}"] + m[f"B{d}"]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    s = {k: np.empty((steps, n, HIDDEN), np.float32) for k in ("i", "f", "o", "g", "c", "h")}
    for t in range(steps):
        z = ahead[t] + h @ m[f"H{d}"]
        ifo = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c = f * c + i * g
        h = o * np.tanh(c)
        for k, v in zip("ifogch", (i, f, o, g, c, h), strict=True):
            s[k][t] = v
    return s


def _lstm_back(x: np.ndarray, s: dict[str, np.ndarray], dh: np.ndarray, m: dict[str, np.ndarray], d: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    steps, n, _ = x.shape
    dz = np.zeros((steps, n, 4 * HIDDEN), np.float32)
    after_h, after_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c = (s[k][t] for k in "ifogc")
        now = dh[t] + after_h
        tc = np.tanh(c)
        dc = after_c + now * o * (1 - tc * tc)
        before = s["c"][t - 1] if t else np.zeros_like(c)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), now * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        after_c, after_h = dc * f, dz[t] @ m[f"H{d}"].T
    flat = dz.reshape(-1, 4 * HIDDEN)
    h0 = np.concatenate([np.zeros((1, n, HIDDEN), np.float32), s["h"][:-1]]).reshape(-1, HIDDEN)
    return {f"X{d}": x.reshape(-1, x.shape[2]).T @ flat, f"H{d}": h0.T @ flat, f"B{d}": flat.sum(axis=0)}, dz @ m[f"X{d}"].T


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, page, feature), which cells hold blocks, and for each cell the step it takes when the page is read backwards."""
    sizes = np.array([len(x) for x in pages])
    x = np.zeros((int(sizes.max()), len(pages), pages[0].shape[1]), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
    step = np.arange(len(x))[:, None]
    return x, step < sizes, np.where(step < sizes, sizes - 1 - step, step)


def _turn(x: np.ndarray, back: np.ndarray) -> np.ndarray:
    return np.take_along_axis(x, back[:, :, None], axis=0)


def _run(m: dict[str, np.ndarray], pages: list[np.ndarray]) -> dict[str, np.ndarray]:
    x, real, back = _padded(pages)
    e = np.tanh(x @ m["E"] + m["e"])
    ahead, behind = _lstm(e, m, "f"), _lstm(_turn(e, back), m, "b")
    both = np.concatenate([e, ahead["h"], _turn(behind["h"], back)], axis=2)
    return {"x": x, "real": real, "back": back, "e": e, "ahead": ahead, "behind": behind, "both": both, "p": _sigmoid(both @ m["o"] + m["q"][0])}


def _slope(m: dict[str, np.ndarray], s: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    g = np.where(s["real"], s["p"] - y, 0).astype(np.float32) / s["real"].sum()
    d = g[:, :, None] * m["o"]
    de = d[:, :, :INNER].copy()
    fore, de_f = _lstm_back(s["e"], s["ahead"], d[:, :, INNER : INNER + HIDDEN], m, "f")
    aft, de_b = _lstm_back(_turn(s["e"], s["back"]), s["behind"], _turn(d[:, :, INNER + HIDDEN :], s["back"]), m, "b")
    dk = (de + de_f + _turn(de_b, s["back"])) * (1 - s["e"] ** 2)
    flat = dk.reshape(-1, INNER)
    return fore | aft | {"E": s["x"].reshape(-1, s["x"].shape[2]).T @ flat, "e": flat.sum(axis=0), "o": (s["both"] * g[:, :, None]).sum(axis=(0, 1)), "q": np.array([g.sum()])}


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 14, batch: int = 48, rate: float = 8e-3, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"E": (WIDE, INNER), "e": (INNER,), "o": (INNER + 2 * HIDDEN,), "q": (1,)} | {f"{k}{d}": s for d in "fb" for k, s in (("X", (INNER, 4 * HIDDEN)), ("H", (HIDDEN, 4 * HIDDEN)), ("B", (4 * HIDDEN,)))}
    m = {k: (rng.normal(size=s) / np.sqrt(s[0]) * (len(s) > 1 or k == "o")).astype(np.float32) for k, s in shapes.items()}
    for d in "fb":
        m[f"B{d}"][HIDDEN : 2 * HIDDEN] = 1  # to remember at first
    mean, square = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    sizes, step = np.array([len(x) for x in pages]), 0
    total = epochs * -(-len(pages) // batch)
    late = {k: np.zeros_like(v) for k, v in m.items()}
    for _ in range(epochs):
        order = np.argsort(sizes + rng.uniform(0, 8, len(sizes)))
        for part in rng.permutation(-(-len(pages) // batch)):
            own = order[part * batch : (part + 1) * batch]
            s = _run(m, [pages[i] for i in own])
            y = np.zeros(s["real"].shape, np.float32)
            for k, i in enumerate(own):
                y[: len(labels[i]), k] = labels[i]
            step += 1
            grads = _slope(m, s, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                m[k] = (m[k] - rate * (1 - 0.95 * step / total) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if step > total - total // 4:
                    late[k] += m[k] / max(1, total // 4)
    return late if total >= 4 else m  # the mean of the last quarter's steps: the last step alone is chance


def label(m: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Chance of each block of each page to be main text; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= AT_ONCE:
            end += 1
        own = order[at:end]
        p = _run(m, [pages[i] for i in own])["p"]
        for k, i in enumerate(own):
            out[i] = p[: len(pages[i]), k]
        at = end
    return out


def sample_pages(n: int, seed: int, families: tuple[str, ...] = FAMILIES) -> tuple[list[list[tuple[Node, str, int, int, int]]], list[np.ndarray]]:
    """Made-up pages, as many of each family, and which of their blocks are main text."""
    rng, pages, labels = random.Random(seed), [], []
    for k in range(n):
        found = blocks(made_page(rng, families[k % len(families)]))
        labels.append(np.array([MARK in b[1] for b in found], np.float32))
        pages.append([(b[0], b[1].replace(MARK, "") or "-", *b[2:]) for b in found])
    return pages, labels


@cache
def model(pages: int = 4000, seed: int = 5, families: tuple[str, ...] = FAMILIES) -> dict[str, np.ndarray]:
    """The labeller, trained once in a driver."""
    found, labels = sample_pages(pages, seed, families)
    return fit([vectors(x) for x in found if x], [y for y in labels if len(y)])


def main_text(m: dict[str, np.ndarray], pages: list[str | None]) -> list[str]:
    found = [blocks(x) for x in pages]
    chances = label(m, [vectors(x) for x in found])
    out = []
    for page, chance in zip(found, chances, strict=True):
        least = ENOUGH if (chance >= ENOUGH).any() else LEAST
        out.append(" ".join(b[1] for b, p in zip(page, chance, strict=True) if p >= least))
    return out


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, m: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Adds text, the main text of each page, to the columns `keep` (all but html by default)."""
    ship(pages.sparkSession)
    m = m or model()
    keep = [c for c in ([c for c in pages.columns if c != html] if keep is None else keep) if c != "text"]
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                part = batch.slice(done, 256)
                done += part.num_rows
                texts = main_text(m, part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], names=schema.fieldNames())

    return pages.select(*[pages[c] for c in keep], pages[html].alias("html_to_read")).mapInArrow(trimmed(run), schema)
