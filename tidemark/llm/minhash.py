r"""Near-duplicates by b-bit MinHash: candidates share a band of minima, packed low bits rule most of them out, full sets decide.

A text is lower-cased (A-Z) and cut into words `[^\x20\x09-\x0D]+`; its set holds the distinct runs of `shingle` words, or the whole
sequence where there are fewer. Two documents are linked if 100 * intersection >= percent * union; a class is what links reach.

How rows stay few: texts with equal sets collapse to their smallest doc_id first, counted before the shuffle. In each band bucket the
packed bits give a spanning forest of likely pairs; what these forests connect is a neighbourhood, and no link leaves one. A bucket
of more than BLOCK members is one neighbourhood as it is: a star, a row a member. The full sets of a neighbourhood's members meet
once, and give a spanning forest of confirmed links: a pair is confirmed or ruled out unless its ends are connected already.

A neighbourhood of more than BLOCK members or BYTES bytes of sets goes by leaders: each member meets its smallest one, in as many tasks
as that takes. Those linked with the leader are one class. 1 - similarity is a metric, so of the rest only those within twice the
threshold's distance of the leader can be linked with that class, and only with its members far enough out; these two sides meet in
blocks, and the rest goes on with a leader of its own. What LEADERS leaders leave meets as pairs of blocks. So a group of copies costs
rows in proportion to its members; no link between classes is passed over.

Rows that are to be joined with a frequent set, bucket or neighbourhood get it by broadcast: at most HOT of them (HOT a band) hold
more than the HOT-th part of all rows. Links between classes of many members go through joins that Spark splits where they are skewed.

Chances of a miss: no common band at the threshold, under 1e-9 a pair (bands follow from the threshold); packed bits that
underestimate by more than SLACK deviations, under 1e-5 a pair, and only where that pair alone joins two classes. Sets hold 64-bit
hashes of shingles: that any two of the shingles of two texts with n each share one by chance is under n * n / 2**64, 1e-9 for texts of
100,000 words, and moves the intersection by one. Equal sets are told by two sums of such hashes and their size, some 128 bits.

Defined cases: null and empty texts, and texts of white space, have empty sets and are linked with nothing; rows with a null doc_id
are their own class, null; a doc_id that occurs on several rows is linked by any of its texts that has a set; repeated rows give repeated rows; a doc_id is cast to
a whole number, what isn't one counts as null or fails as Spark's setting for casts says;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesops as B
from tidemark.llm.runtime import cut, drop
from tidemark.plans.shipping import ship

MINIMA, ROWS, BITS, SLACK, BLOCK, BYTES, LEADERS, HOT = 256, 4, 2, 4.5, 2048, 1 << 26, 8, 4096
_rng = np.random.default_rng(1729)
_XOR = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIRS = np.uint64(0x5555555555555555)


def bands_for(percent: int, rows: int = ROWS, miss: float = 1e-9) -> int:
    """Bands enough that a pair at the threshold shares none with a chance under `miss`."""
    return min(MINIMA // rows, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)))


def least_estimate(percent: int) -> float:
    """Estimates below this rule a pair out."""
    s = percent / 100
    p = s + (1 - s) / 2**BITS
    return s - SLACK * math.sqrt(p * (1 - p) / MINIMA) / (1 - 2**-BITS)


def shingle_sets(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text, one after another, and how many each has."""
    data = B.LOWER[data]
    start, end, row = B.words(data, at)
    n = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(n) - n
    own = B.word_hashes(data, start, end)
    joined = np.zeros(max(0, len(own) - shingle + 1), np.uint64)
    for k in range(shingle):
        joined = B.mix(joined * np.uint64(B.BASE) + own[k : len(own) - shingle + 1 + k]) if len(joined) else joined
    sets = []
    for i, f in zip(n.tolist(), first.tolist(), strict=True):
        if i >= shingle:
            sets.append(np.unique(joined[f : f + i - shingle + 1]))
        elif i:
            h = np.full(1, i, np.uint64)
            for k in range(i):
                h = B.mix(h * np.uint64(B.BASE) + own[f + k])
            sets.append(h)
        else:
            sets.append(own[:0])
    return np.concatenate(sets) if sets else own[:0], np.array([len(x) for x in sets], dtype=np.int64)


def signatures(hashes: np.ndarray, counts: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two sums that stand for each set, its band hashes and its packed low bits; sets without members get zeros."""
    n, full = len(counts), np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[full]
    sums, minima = np.zeros((2, n), np.uint64), np.zeros((MINIMA, len(full)), np.uint32)
    if len(full):
        sums[0, full] = np.add.reduceat(hashes, first)
        sums[1, full] = np.add.reduceat(B.mix(hashes), first)
        for k in range(MINIMA):
            minima[k] = np.minimum.reduceat((((hashes ^ _XOR[k]) * _TIMES[k]) >> np.uint64(32)).astype(np.uint32), first)
    keys = np.zeros((n, bands), np.uint64)
    for b in range(bands):
        h = np.full(len(full), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = B.mix(h * np.uint64(B.BASE) + minima[k])
        keys[full, b] = h
    packed = np.zeros((n, MINIMA * BITS // 64), np.uint64)
    per = 64 // BITS
    for k in range(MINIMA):
        packed[full, k // per] |= (minima[k].astype(np.uint64) & np.uint64(2**BITS - 1)) << np.uint64(k % per * BITS)
    return sums[0], sums[1], keys, packed


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by counts of equal low bits, less those that are equal by chance."""
    x = a ^ b
    unequal = np.bitwise_count((x | (x >> np.uint64(1))) & _PAIRS).sum(axis=-1, dtype=np.int64)
    return (1 - unequal / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)


def sign(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, sum_a, sum_b, bands and packed of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in B.chunks(*B.utf8(batch.column(1))):
                hashes, counts = shingle_sets(data, at, shingle)
                a, b, keys, packed = signatures(hashes, counts, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                raw = pa.array([x.tobytes() for x in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(counts), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists, raw], names=["doc_id", "n_shingles", "sum_a", "sum_b", "bands", "packed"])

    return docs.select("doc_id", "text").mapInArrow(B.trimmed(run), "doc_id long, n_shingles long, sum_a long, sum_b long, bands array<long>, packed binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, many runs at once, never one run in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for k in range(keys):
            c = batch.column(k).to_numpy(zero_copy_only=False)
            same &= c == c[-1]
        begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if begin == 0 and held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in range(keys)):
            held.append(batch)
            continue
        if held or begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
        held = [batch.slice(begin)]
    if held:
        yield pa.Table.from_batches(held)


def _shares(one: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and unions of a sorted set with others."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both, sizes + len(one) - both


def _forest(packed: np.ndarray, block: np.ndarray, least: float, sets: list[np.ndarray] | None = None, percent: int = 0) -> list[tuple[int, int]]:
    """Pairs that connect all that likely pairs connect, or, with the sets, all that confirmed links connect.

    If the members are of two blocks, pairs within a block are left to others.
    """
    n, out = len(packed), []
    label, cross = np.arange(n), bool((block != block[0]).any())
    for r in range(1, n):
        score = estimates(packed[:r], packed[r])
        near = score >= least
        if cross:
            near &= block[:r] != block[r]
        left, step = np.flatnonzero(near), 8
        left = left[np.argsort(-score[left], kind="stable")]
        while len(left):
            if sets is None:
                found = left
            else:
                part = left[:step]
                both, union = _shares(sets[r], [sets[i] for i in part])
                found, left, step = part[100 * both >= percent * union], left[step:], 4 * step
            for c in found.tolist():
                if label[c] != label[r]:
                    out.append((r, c))
                    label[label == label[c]] = label[r]
            left = left[label[left] != label[r]]
    return out


def _edges(members: DataFrame, keys: list[str], least: float, percent: int | None = None) -> DataFrame:
    """The forests of the groups by keys; members has rep, block and packed, and with `percent` own, the set."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, n):
            ids, block = t.column("rep").to_numpy(), t.column("block").to_numpy()
            packed = np.frombuffer(b"".join(t.column("packed").to_pylist()), dtype=np.uint64).reshape(t.num_rows, -1)
            sets = None if percent is None else [np.frombuffer(x, np.uint64) for x in t.column("own").to_pylist()]
            edge = np.zeros(t.num_rows, dtype=bool)
            edge[0] = True
            for k in range(n):
                c = t.column(k).to_numpy()
                edge[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(edge).tolist()
            pairs = [(f + x, f + y) for f, e in zip(first, [*first[1:], t.num_rows], strict=True) if e - f > 1 for x, y in _forest(packed[f:e], block[f:e], least, sets and sets[f:e], percent or 0)]
            if pairs:
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    columns = [*keys, "rep", "block", "packed", *["own"] * (percent is not None)]
    rows = members.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "rep")
    return rows.mapInArrow(B.trimmed(run), "a long, b long").filter("a <> b").distinct()


def _dealt(members: DataFrame) -> DataFrame:
    """Adds block and pair: a group of several `blocks` as pairs of blocks, each member in every pair of its block."""
    out = members.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.least("block", t) * F.col("blocks") + F.greatest("block", t))
    return out.withColumn("pair", F.explode(pairs)).drop("blocks")


def _blocks(most: int, n: str = "n", size: str = "bytes") -> Column:
    return F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(size) / BYTES), F.lit(1)).cast("int")


def _met(left: DataFrame, right: DataFrame, key: list[str], weight: str, enough: float, how: str = "inner") -> DataFrame:
    """left joined with right, one row a key; keys of more than `enough` rows of left, by right's column weight, by broadcast.

    The weights add up to the rows of left, so few keys can weigh so much.
    """
    hot = F.broadcast(right.filter(F.col(weight) > enough))
    rest = right.filter(F.col(weight) <= enough)
    return left.join(hot, key).unionByName(left.join(hot.select(*key), key, "left_anti").join(rest, key, how))


def _to_leaders(live: DataFrame) -> DataFrame:
    """hood, rep, lead, both and union of each member of live and the smallest member of its hood; the leader itself not."""
    lead = live.groupBy("hood").agg(F.min(F.struct("rep", "own")).alias("first"), F.max("blocks").alias("blocks"))
    lead = lead.select("hood", F.col("first.rep").alias("lead"), F.col("first.own").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    dealt = live.select("hood", "rep", "own", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("salt"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, blank = ["hood", "rep", "lead", "both", "union"], pa.array([], pa.int64())
        if not (left.num_rows and right.num_rows):
            return pa.table([blank] * 5, names=names)
        lead, own = right.column("lead")[0].as_py(), right.column("own")[0].as_py()
        left = left.filter(pc.or_(pc.not_equal(left.column("rep"), lead), pc.not_equal(left.column("own"), pa.scalar(own, left.column("own").type))))
        if not left.num_rows:
            return pa.table([blank] * 5, names=names)
        both, union = _shares(np.frombuffer(own, np.uint64), [np.frombuffer(x, np.uint64) for x in left.column("own").to_pylist()])
        return pa.table([left.column("hood"), left.column("rep"), pa.array(np.full(left.num_rows, lead)), pa.array(both), pa.array(union)], names=names)

    return dealt.groupBy("hood", "salt").cogroup(lead.select("hood", "salt", "lead", "own").groupBy("hood", "salt")).applyInArrow(B.trimmed_group(run), "hood long, rep long, lead long, both long, union long")


def _large(live: DataFrame, least: float, percent: int, most: int) -> DataFrame:
    """Links that connect all that confirmed links connect in hoods too large for one task; live has hood, rep, packed, own and blocks."""
    found: list[DataFrame] = []
    for _ in range(LEADERS):
        met = cut(_to_leaders(live), "met")
        linked = F.col("both") * 100 >= F.col("union") * percent
        found.append(met.filter(linked).select(F.col("lead").alias("a"), F.col("rep").alias("b")))
        rest = met.filter(~linked)
        if rest.isEmpty():
            break
        share = F.col("both") / F.col("union")
        near = rest.filter(F.col("both") * 100 >= F.col("union") * (2 * percent - 100)).select("hood", "rep", share.alias("share"))
        most_near = near.groupBy("hood").agg(F.max("share").alias("top"), F.count("*").alias("n_near"))
        out = met.filter(linked).join(most_near, "hood").filter(share <= F.col("top") + (1.001 - percent / 100)).select("hood", "rep", "n_near")
        n_out = out.groupBy("hood").agg(F.count("*").alias("n_out"))
        # Two sides in blocks: a block of one with every block of the other; `block` tells the sides apart.
        sides = near.join(n_out, "hood").join(most_near, "hood").select("hood", "rep", F.col("n_near").alias("n"), F.col("n_out").alias("others"), F.lit(0).alias("block"))
        sides = sides.unionByName(out.join(n_out, "hood").select("hood", "rep", F.col("n_out").alias("n"), F.col("n_near").alias("others"), F.lit(1).alias("block")))
        mine, theirs = (F.ceil(F.col(c) / max(1, most // 2)).cast("int") for c in ("n", "others"))
        sides = sides.withColumns({"own_block": F.pmod(F.xxhash64("rep"), mine).cast("int"), "theirs": theirs, "mine": mine}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
        pair = F.when(F.col("block") == 0, F.col("own_block") * F.col("theirs") + F.col("other")).otherwise(F.col("other") * F.col("mine") + F.col("own_block"))
        cross = sides.select("hood", "rep", "block", pair.alias("pair")).join(live.select("hood", "rep", "packed", "own"), ["hood", "rep"])
        found.append(cut(_edges(cross, ["hood", "pair"], least, percent), "crossing"))
        live = live.drop("blocks").join(rest.select("hood", "rep"), ["hood", "rep"], "left_semi")
        sizes = live.groupBy("hood").agg(F.count("*").alias("n"), F.sum(F.octet_length("own")).alias("bytes"))
        live = cut(live.join(sizes.select("hood", _blocks(most).alias("blocks")), "hood"), "live")
        found.append(_edges(live.filter("blocks = 1").withColumns({"block": F.lit(0)}), ["hood"], least, percent))
        live = live.filter("blocks > 1")
        if live.isEmpty():
            break
    else:
        found.append(_edges(_dealt(live), ["hood", "pair"], least, percent))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, class) for the nodes of the links: the smallest node that links reach, by labels that spread and jump until none changes."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(edges.filter("a <> b").distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("class")), "labels")
    whole = labels
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), F.col("class").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("further"))
        step = step.join(jump, "class", "left").select("node", "old", F.coalesce(F.least("class", "further"), "class").alias("class"))
        step = cut(step, "labels")
        drop(whole)
        whole, labels = step, step.select("node", "class")
        if step.filter("class <> old").isEmpty():
            drop(edges)
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, most: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept (doc_id = component_id) for each row of docs."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands, least, key = bands_for(percent), least_estimate(percent), ["n_shingles", "sum_a", "sum_b"]
    signed = cut(sign(docs, shingle, bands), "signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = cut(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    # A set's bands and bits come with its smallest doc_id: by both, so that a frequent set is no frequent key.
    own = cut(usable.withColumnRenamed("doc_id", "rep").join(reps, [*key, "rep"]).select("rep", "bands", "packed"), "own")
    enough = max(most, signed.count() / HOT)
    spread = own.select("rep", F.explode("bands").alias("band"))
    buckets = cut(spread.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high"), "buckets")
    placed = cut(_met(spread, buckets.select("band", "n", "low"), ["band"], "n", enough), "placed")
    small = placed.filter(F.col("n") <= most).select("rep", "band").withColumn("block", F.lit(0)).join(own.select("rep", "packed"), "rep")
    stars = placed.filter(F.col("n") > most).select(F.col("low").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    likely = cut(_edges(small, ["band"], least).union(stars), "likely", release=True)
    hoods = components(likely)
    hoods = hoods.select(F.col("class").alias("hood"), F.col("node").alias("rep"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in B.chunks(*B.utf8(batch.column(1))):
                hashes, counts = shingle_sets(data, at, shingle)
                raw = [x.tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])]
                _, _, _, packed = signatures(hashes, counts, 0)
                columns = [batch.column(0).slice(first, last - first), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "packed", "own"])

    wanted = docs.join(hoods.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    full = wanted.mapInArrow(B.trimmed(sets), "rep long, packed binary, own binary").filter("octet_length(own) > 0")
    members = cut(full.dropDuplicates(["rep", "own"]).join(hoods, "rep"), "members")
    sizes = members.groupBy("hood").agg(F.count("*").alias("n"), F.sum(F.octet_length("own")).alias("bytes"))
    sizes = cut(sizes.withColumn("blocks", _blocks(most)).filter("n > 1"), "sizes")
    placed = _met(members, sizes.select("hood", "blocks", "n"), ["hood"], "n", enough)
    confirmed = _edges(placed.filter("blocks = 1").withColumn("block", F.lit(0)), ["hood"], least, percent)
    if not sizes.filter("blocks > 1").isEmpty():
        confirmed = confirmed.union(_large(cut(placed.filter("blocks > 1").drop("n"), "live"), least, percent, most))
    # A doc_id on several rows links all its sets.
    name = F.struct(*key)
    several = usable.groupBy("doc_id").agg(F.min(name).alias("low"), F.max(name).alias("high")).filter("low <> high").select("doc_id")
    several = usable.select("doc_id", *key).join(several, "doc_id").distinct().join(reps.select(*key, "rep"), key)
    several = several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    labels = components(cut(confirmed.union(several), "links", release=True))
    known = reps.select(*key, "rep", "copies").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.filter("copies > 1 OR class IS NOT NULL").select(*key, "copies", F.coalesce("class", "rep").alias("class"))
    out = _met(usable.select("doc_id", *key), known, key, "copies", enough, "left")
    # A set's smallest doc_id may be another's too, but a doc_id with several sets has a link with each.
    out = out.select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))
    alone = signed.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
