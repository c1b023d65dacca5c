"""The ten operators against brute force, round trips and held-out accuracy, with nulls, empty and repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, bytesops, chat, decontaminate, html_extract, lm_score, minhash, quality_model, quality_rules, queries, suffix_dedup, token_counts
from tidemark.llm.queries import vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that any operator on documents must bear, with columns whose names operators use themselves."""
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "the same text is here twice over"), (5, "the same text is here twice over"), (None, "no id at all"), (7, "x" * 20000), (8, "é퟿😀 " * 300)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(9) for c in ("n_tokens", "score", "kept", "q", "rep", "n_bytes", "lang", "source", "n_words")})


def test_chat(spark):
    texts = ["\\### Assistant: </turn> ok", "####\\\\ </turn></turn>\\", "x\n", None, "", "<\\/turn> \\#"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "we:ird#\\", None, "user", "assistant"], texts, strict=True))] + [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("state", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv in (1, 2, 3, None):
        want = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].formatted.count("</turn>") == len(want)
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
    assert (got[1].valid, got[2].valid, got[3].valid) == (False, True, False)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_quality_rules(spark, odd):
    def brute(text):
        w = WORDS.findall(text or "")
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\t", "the ", "\n", "x# ", "a b c d e f g h "]) for _ in range(rng.randint(0, 60)))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == 109
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(odd).count() == 9 and quality_rules.quality_rules(odd.limit(0)).count() == 0


def classes(rows, shingle, percent):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(table))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize(("shingle", "percent", "most"), [(3, 85, minhash.BLOCK), (5, 80, 25), (3, 85, 4)])
def test_minhash(spark, shingle, percent, most):
    rng = random.Random(shingle)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "A  b"), (205, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("band", F.lit(1))
    got = minhash.near_duplicates(df, shingle, percent, most).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == classes(rows, shingle, percent) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_hot_group_goes_by_leaders(spark):
    """Edits of one text, most of them linked and some a chain away, in a group far over the size of a task."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice((1, 1, 1, 2, 3, 5, 8))):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 20).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == classes(rows, 3, 85)


def test_minhash_no_pattern_collides(spark):
    """Thue-Morse words, on which polynomial hashes modulo a power of two agree whatever their base."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    rows = [(1, words[0]), (2, words[1]), (3, "x y " + words[0]), (4, "x y " + words[1])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert all(r.kept for r in got) and len(got) == 4
    data = np.frombuffer("".join(words).encode() * 2, np.uint8)
    h = bytesops.word_hashes(data, np.array([0, 4096, 8192, 0]), np.array([4096, 8192, 12288, 64]))
    assert h[0] == h[2] and len(set(h.tolist())) == 3


def test_minhash_odd(spark, odd):
    got = minhash.near_duplicates(odd, 3, 85).collect()
    assert len(got) == 9 and sum(r.doc_id == 5 and r.component_id == 5 for r in got) == 2 and [r.component_id for r in got if r.doc_id is None] == [None]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_b_bit_estimate_is_near():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 4000), dtype=np.uint64)
    for share in (0.3, 0.85):
        k = int(4000 * share)
        hashes = np.concatenate([np.sort(a), np.sort(np.concatenate([a[:k], b[k:]]))])
        packed = minhash.signatures(hashes, np.array([4000, 4000]), 4)[3]
        assert abs(float(minhash.estimates(packed[0], packed[1])) - k / (8000 - k)) < 0.1


def without_repeats(rows):
    """doc_id as text, bytes, bytes removed, runs removed and digest of what is left of each row, string by string."""
    first: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raws:
        for i in range(len(b) - 49) if d is not None else ():
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - 49) if d is not None else ():
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((str(d), len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return want


@pytest.mark.parametrize("most", [suffix_dedup.BLOCK, 7])
def test_suffix_dedup(spark, odd, most):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 300))) for _ in range(8)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice([rng.choice(base)[rng.randint(0, 100) :][: rng.randint(20, 200)], "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), "ha" * rng.randint(0, 40)]) for _ in range(rng.randint(0, 5)))
        rows.append((i if i % 10 else rng.choice([i, i // 2, None]), t if i % 37 else None))
    rows += rows[:3]
    want = without_repeats(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, text=False, digest=True, most=most).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_suffix_dedup_refuses_what_only_hashes_alike(spark):
    """With hashes that say nothing, removals still rest on bytes."""
    rng = random.Random(8)
    line = "this line of more than fifty bytes stands in very many of the documents of this table. "
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(30)) + (line if i % 3 else "") + str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, text=False, digest=True).collect()}
    assert sum(n >= len(line) for n, _ in want.values()) >= 130
    raw = np.frombuffer(b"ab" * 50 + b"ac" * 50, np.uint8)
    gone = suffix_dedup._within(raw, np.array([0, 100, 200]), np.array([1, 2]), np.array([0, 1]), np.array([0, 0]), np.array([60, 60]), np.zeros(2, np.uint64))
    assert gone.tolist() == [False, False]
    same = suffix_dedup._within(raw, np.array([0, 100, 200]), np.array([1, 2]), np.array([0, 1]), np.array([0, 0]), np.array([1, 1]), np.zeros(2, np.uint64))
    assert same.tolist() == [False, True]


def test_suffix_dedup_odd(spark, odd):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == 9 and all(r.n_removed == 0 for r in got) and {r.lang for r in got} == {9}
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_suffix_sort():
    data = np.frombuffer(b"banana$bandana$ananas$aaaaaaaa$", np.uint8)
    start = np.arange(len(data))
    end = np.full(len(data), len(data))
    order, common = suffix_dedup.sorted_suffixes(data, start, end)
    text = data.tobytes()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def tiktoken_encoding():
    import tiktoken

    path, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe(spark, odd):
    enc = tiktoken_encoding()
    texts = ["", " ", "  a  b", "\n\n x", "x  y　 z\x1c a", "don't  ", "a  b", "日本 語\t\tx", "<|endoftext|> hi", "é ́x", " 1 2  3!!  ?? a", "the the  the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    encoded = bpe.encode(df, *vocabulary(), offsets=True)
    for r in bpe.decode(encoded, *vocabulary(), text=True).collect():
        text = r.text or ""
        assert r.token_ids == enc.encode_ordinary(text) and r.decoded_text == text and r.n_tokens == len(r.token_ids)
        if r.token_ids:
            assert r.token_starts[0] == 0 and r.token_ends[-1] == len(text)
            assert all(bpe.coder(*vocabulary()).decode(np.array([i])) in text[a:b].encode() for i, a, b in zip(r.token_ids, r.token_starts, r.token_ends, strict=True))
    assert bpe.encode(odd, *vocabulary()).count() == 9 and bpe.encode(odd.limit(0), *vocabulary()).count() == 0
    coder = bpe.coder(*vocabulary())
    ids = np.array(enc.encode_ordinary("a 😀 b"))
    assert "".join(coder.decode_stream([ids[i : i + 1] for i in range(len(ids))])) == "a 😀 b"
    with pytest.raises(ValueError, match="vocabulary"):
        coder.decode(np.array([60000]))


def test_bpe_round_trip_in_one_pass(spark, odd):
    path, pattern = vocabulary()
    two = bpe.decode(bpe.encode(odd, path, pattern), path, pattern, digest=True)
    one = bpe.round_trip(odd, path, pattern)
    names = ["doc_id", "lang", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    key = lambda df: sorted(map(str, df.select(*names).collect()))
    assert key(one) == key(two) and "score" in one.columns
    assert bpe.round_trip(odd.limit(0), path, pattern).count() == 0 and "token_ids" not in bpe.round_trip(odd, path, pattern, ids=False).columns
    other = r"\s+|[^\s]+"
    assert [r.t for r in bpe.decode(bpe.encode(odd.select("text"), path, other), path, other, text=True).select(F.col("decoded_text").alias("t")).collect()] == [r.text or "" for r in odd.collect()]


def test_token_counts(spark, odd):
    lengths = [len(tiktoken_encoding().encode_ordinary(r.text or "")) for r in odd.select("text").collect()]
    hist = token_counts.histogram(token_counts.lengths(odd, *vocabulary()))
    table = token_counts.limits(hist, block=3)
    rows = {r.n_tokens: r for r in table.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r.n_docs == lengths.count(limit) and r.docs_at_least == sum(n >= limit for n in lengths) and r.tokens_at_least == sum(n for n in lengths if n >= limit)
        assert r.tokens_when_cut == sum(min(n, limit) for n in lengths) and r.docs_cut == sum(n > limit for n in lengths) and r.tokens_in_all == sum(lengths)
    assert token_counts.quantile(table, 0.5).first().n_tokens == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.cut_at(hist, 4).first().tokens == sum(min(n, 4) for n in lengths)
    assert token_counts.limits(hist.limit(0)).count() == 0


def test_quality_model(spark, odd):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.select("doc_id", F.col("quality").alias("label"))
    model = quality_model.train(docs, known.filter("doc_id % 4 <> 0"))
    held = quality_model.score(docs, model).join(known.filter("doc_id % 4 = 0"), "doc_id").collect()
    assert sum((r.score >= 0.3) == (r.label == 1) for r in held) >= 0.9 * len(held)
    scored = quality_model.score(odd, model).collect()
    assert len(scored) == 9 and all(0 <= r.score <= 1 for r in scored) and quality_model.score(odd.limit(0), model).count() == 0
    assert {r.score for r in quality_model.score(odd, quality_model.train(docs, known.limit(0))).collect()} == {0.5}


def test_quality_model_gradients():
    rng = np.random.default_rng(2)
    x, sizes, y = rng.normal(size=(7, quality_model.FEATURES)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    m = quality_model.fit(x, sizes, y, epochs=1)
    begin, text_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(3), sizes)
    loss = lambda: -np.mean(np.log(np.where(y == 1, (p := quality_model._forward(m, x, begin, text_of)["p"]), 1 - p)))
    for k, g in quality_model._gradients(m, quality_model._forward(m, x, begin, text_of), y, begin, text_of).items():
        at = tuple(0 for _ in m[k].shape)
        m[k][at] += 1e-5
        up = loss()
        m[k][at] -= 2e-5
        down = loss()
        m[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_lm_score(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    v, net = lm_score.fit(docs)
    got = {r.doc_id: r for r in lm_score.score(docs, v, net).collect()}
    for r in docs.limit(5).collect():
        ids = v.ids(lm_score.text_words(*bytesops.utf8(pa.array([r.text])))[0])
        total = 0.0
        for i, x in enumerate(ids.tolist()):
            around = [int(ids[i + k]) if 0 <= i + k < len(ids) else lm_score.EDGE for k in (-2, -1, 1, 2)]
            h = np.tanh(net["b"] + sum(net["T"][k][a] for k, a in enumerate(around)))
            c, m = divmod(x, lm_score.MEMBERS)
            z, w = h @ net["Wc"] + net["bc"], (h + net["Ec"][c]) @ net["Wr"] + net["br"][c]
            total += z[c] - np.log(np.exp(z).sum()) + w[m] - np.log(np.exp(w).sum())
        assert got[r.doc_id].n_words == len(ids) and got[r.doc_id].log_likelihood == pytest.approx(total, rel=1e-3, abs=1e-2)
    start = lm_score.start_net(v)
    mean = lambda n: lm_score.score(docs, v, n).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    assert mean(net) > mean(start)
    shuffled = docs.withColumn("text", F.array_join(F.shuffle(F.split("text", " ")), " "))
    assert lm_score.score(shuffled, v, net).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0] < mean(net)
    rows = lm_score.score(odd, v, net).collect()
    assert len(rows) == 9 and sum(r.per_word is None for r in rows) == 3
    assert lm_score.lm_score(odd.limit(0)).count() == 0


def test_lm_score_does_not_depend_on_tasks(spark, monkeypatch):
    """Shards follow from the corpus: 1, 8 and 40 partitions, in whatever order, give the same scores; training beats the counts on texts it hasn't seen."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    seen, unseen = docs.filter("doc_id % 4 > 0").cache(), docs.filter("doc_id % 4 = 0")
    monkeypatch.setattr(lm_score, "SHARD", 4000)
    assert lm_score.shards(seen.selectExpr("sum(size(split(trim(text), ' ')))").first()[0], 2) > 4
    every = []
    for parts in (1, 8, 40):
        v, net = lm_score.fit(seen.repartition(parts, F.rand(parts)))
        every.append({r.doc_id: r.per_word for r in lm_score.score(unseen.repartition(parts), v, net).collect()})
    assert all(every[0][d] == pytest.approx(x[d], rel=1e-6) for x in every for d in x)
    monkeypatch.undo()
    counts = lm_score.cut(lm_score.count_words(seen), "words")
    v, net = lm_score.fit(seen, counts=counts)
    mean = lambda n: lm_score.word_scores(unseen, v, n, counts).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    assert mean(net) > mean(lm_score.start_net(v)) + 0.02


def test_lm_score_of_words(spark, odd):
    """Every word has a probability of its own: rare words share an id by their counts, unseen ones are spelled."""
    rare = [f"rare{i}" for i in range(6000)]
    rng = random.Random(2)
    rows = [(i, " ".join(["The", "common", *rng.choices(rare, k=20)])) for i in range(1200)] + [(None, "rare1 rare2"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm_score.count_words(docs)
    v, net = lm_score.fit(docs)
    n, known = Counter(w for _, t in rows for w in (t or "").lower().split()), set(v.words.tolist())
    key = lambda w: int(lm_score.text_words(*bytesops.utf8(pa.array([w])))[0][0])
    sums = Counter()
    for w, k in n.items():
        sums[key(w) % lm_score.BUCKETS] += k if key(w) not in known else 0

    def share(w):
        if key(w) in known:
            return 0.0
        return (np.log(n[w]) if n[w] else -np.log(257) * (len(w.encode()) + 1)) - np.log(sums[key(w) % lm_score.BUCKETS] + 1)

    asked = docs.unionByName(spark.createDataFrame([(5000, "the common rare3"), (5001, "zq1 zq2 zq3")], "doc_id long, text string"))
    ids = {r.doc_id: r for r in lm_score.score(asked, v, net).collect() if r.doc_id is not None}
    got = lm_score.word_scores(asked, v, net, counts).collect()
    assert len(got) == len(rows) + 2 and sum(r.doc_id is None for r in got) == 2
    texts = {i: t for i, t in rows} | {5000: "the common rare3", 5001: "zq1 zq2 zq3"}
    for r in got:
        if r.doc_id is not None:
            want = ids[r.doc_id].log_likelihood + sum(map(share, texts[r.doc_id].lower().split()))
            assert r.log_likelihood == pytest.approx(want, rel=1e-6, abs=1e-4)
    by = {r.doc_id: r.per_word for r in got}
    assert by[5000] > by[5001] + 5
    whole = {r.doc_id: r.log_likelihood for r in lm_score.lm_score(docs).collect() if r.doc_id is not None}
    assert sum(whole.values()) < sum(ids[i].log_likelihood for i in whole) - 5 * len(whole)
    assert len(lm_score.lm_score(odd).collect()) == 9


def test_html_extract(spark):
    """Families of layouts that the labeller has never seen: of each, nine blocks in ten are found and nine in ten of those found are right."""
    unseen = ("grid", "table", "sections")
    m = html_extract.model(900, 5, tuple(f for f in html_extract.FAMILIES if f not in unseen))
    for family in unseen:
        pages, labels = html_extract.sample_pages(100, 99, (family,))
        real, found = np.concatenate(labels) > 0, np.concatenate(html_extract.label(m, [html_extract.vectors(x) for x in pages])) >= html_extract.ENOUGH
        assert (real & found).sum() >= 0.9 * real.sum(), family
        assert (real & found).sum() >= 0.9 * found.sum(), family
    grid = "<html><body><div class='row'><div class='col-md-2'><a href=/>Home</a> <a href=/b>Blog</a></div><div class='col-md-8 story-body'><h2>Floods in the valley</h2><div>Heavy rain fell over the whole region on Monday, and the river rose by two metres.</div><div>Nobody was hurt, but <b>forty</b> houses were damaged &amp; the bridge is&nbsp;closed.</div><noscript>The map needs a script to move.</noscript><div>Energy is <math><mi>E</mi></math>, said one of them.</div></div></div><div class='row'>Copyright 2020 The Valley Times</div><script>x = '<p>no</p>'</script></body></html>"
    want = "Floods in the valley Heavy rain fell over the whole region on Monday, and the river rose by two metres. Nobody was hurt, but forty houses were damaged & the bridge is closed. The map needs a script to move. Energy is E, said one of them."
    rows = [(1, grid), (2, None), (3, ""), (4, "<p>"), (1, grid), (None, "<script>only()</script>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = {(r.page_id, r.text) for r in html_extract.extract(df, m=m).collect()}
    assert got == {(1, want), (2, ""), (3, ""), (4, ""), (None, "")}
    assert html_extract.extract(df.limit(0), m=m).count() == 0


def test_html_deep_and_long_pages():
    began = time.time()
    (node, text, *_), *rest = html_extract.blocks("<div class=a>" * 30_000 + "x" * 1_000_000 + "</div>" * 30_000)
    assert (node.depth, len(text), rest) == (30_000, 1_000_000, [])
    assert html_extract.vectors([(node, text, *_)]).shape == (1, html_extract.WIDE)
    assert len(html_extract.blocks("<div><p>" * 20_000)) == 0
    assert len(html_extract.blocks("<li>one</b></i>" * 20_000)) == 20_000
    assert time.time() - began < 20


def test_decontaminate(spark, odd):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    benchmark = [(r.item_id, grams(words(r.text))) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, g in benchmark if g and len(g & grams(words(r.text))) >= 0.8 * len(g)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert want and got == want
    assert decontaminate.clean(docs, items).count() == docs.count() - len({d for d, _ in want})
    item = spark.createDataFrame([(1, "What is it that the same text is here twice over again?  Yes."), (2, None), (3, "")], "item_id long, text string")
    held = spark.createDataFrame([(1, "pad " * 300 + "WHAT is it, that the same text is here twice over again? yes!" + " pad" * 90)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in decontaminate.contaminated(held.unionByName(odd.select("doc_id", "text")), item).collect()] == [(1, 1, 1.0, 1.0)]
    assert decontaminate.contaminated(docs, item.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.clean(odd, item).count() == 9


def test_decontaminate_scores_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice([f"w{rng.randint(0, 30)}", f"r{rng.randint(0, 400)}"]) for _ in range(rng.randint(12, 40))) for _ in range(40)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, ""), (91, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i if i % 5 else None, "pad " * 50 + " ".join(w for k, w in enumerate(t.split()) if k != 3 or i % 5 == 0)) for i, t in enumerate(texts)] + [(None, "clean text"), (None, None)], "doc_id long, text string")
    rows = lambda: sorted((str(r.doc_id), r.item_id, round(r.score, 5)) for r in decontaminate.contaminated(docs, items, 0.5, 0.3).collect())
    whole = rows()
    assert len(whole) >= 30
    assert [r.text for r in decontaminate.clean(docs, items, 0.5, 0.3).filter("doc_id IS NULL").collect()] == ["clean text", None]
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 21)
    assert rows() == whole


def test_clean_judges_rows_by_their_texts(spark, monkeypatch):
    """Items and rows without ids, ids on several rows, repeated rows: in one block and in many."""
    items = [(None, "Which river is the longest of all the rivers of the known world? It is the river that runs by the old town."), (2, "What do the seven blue birds sing about in the morning hours? They sing of rain and wind.")]
    items += [(10 + i, f"Question number {i} asks what item {i} of the long list may be called? It is called thing number {i} by all.") for i in range(8)]
    dirty = [f"some words before it {t} and some words after it" for _, t in items]
    rows = [(None, dirty[0]), (1, dirty[1]), (1, "a clean text that shares its id with one that is not"), (None, "clean and without an id"), (5, dirty[2]), (5, dirty[2]), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(3))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    left = sorted((str(d), str(t), 3) for d, t in rows if t not in dirty)
    hits = {(None, None), (1, 2), (5, 10)}
    for most in (20_000, 3):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", most)
        assert sorted((str(r.doc_id), str(r.text), r.score) for r in decontaminate.clean(docs, benchmark).collect()) == left
        found = decontaminate.contaminated(docs, benchmark).collect()
        assert {(r.doc_id, r.item_id) for r in found} == hits and len(found) == 4
        assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(rows) and decontaminate.clean(docs.limit(0), benchmark).count() == 0
    sizes = [len(ix.ids) for _, ix in decontaminate._indexes(benchmark, 0.7)]
    assert sum(sizes) == len(items) and max(sizes) <= 3


def test_quality_model_does_not_see_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(queries.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in queries.quality_scores(docs, x, ["doc_id"]).collect()} for x in (labels, turned))
    assert a == pytest.approx(b, abs=1e-9) and len(a) == docs.count() and all(0 <= x <= 1 for x in a.values())


def test_long_texts(spark):
    """Texts of ten million bytes, one of them a single word, beside short ones."""
    rng = random.Random(6)
    line = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)) + "\n"
    long = "".join(line[rng.randint(0, 5) :] for _ in range(850))
    rows = [(1, long), (2, long + "end"), (3, "x" * 10_000_000), (4, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in minhash.near_duplicates(docs, 3, 85).orderBy("doc_id").collect()] == [1, 1, 3, 4]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, text=False, digest=True).collect()}
    assert got[2].n_removed >= len(long) and got[1].n_removed == got[3].n_removed == 0
    item = line[:400] + "? " + line[400:700]
    hit = decontaminate.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in hit} == {1, 2}


def test_index_finds_all_that_full_scoring_finds():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, rng.integers(3, 12)))) for i in range(23)]
    index = decontaminate.Index(items, 0.6)
    passages = [np.unique(rng.choice(len(index.terms), 25)) for _ in range(60)]
    p, t = np.repeat(np.arange(60), [len(x) for x in passages]), np.concatenate(passages)
    got = set(zip(*(x.tolist() for x in index.search(p, t)[:2]), strict=True))
    width, _, keys, values = index.impacts
    full = np.zeros((len(index.terms), width))
    full.ravel()[keys] = values
    want = {(i, j) for i, x in enumerate(passages) for j in range(width) if full[x, j].sum() >= 0.6}
    assert got == want and want
