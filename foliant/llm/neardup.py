"""Groups of near-duplicate texts by set similarity of character substrings (problem 4).

A text is the set of its substrings of ``width`` characters. Two ways to candidates are built; every
candidate is verified on the whole sets.

``minhash`` (what the queries use; README: why, with measured figures): one-permutation MinHash with
banding. Under each of several random orders of all tokens the least token of each of ``bands`` hash
classes is taken, and the tokens of one class under all orders form one combination, which is indexed.
Two texts of similarity s share one with probability 1 - (1 - s^orders)^bands. Low bits of each
combination sketch the rest of the text, so most chance meetings end before any text is moved; at s =
0.8 a pair of texts with ``LEAST_TOKENS`` or more different tokens is lost with 1e-6 if classes are
independent. Texts with fewer leave classes empty, which then repeat each other: they are indexed by
prefixes of their sorted tokens as well, which loses no pair.

``prefix`` (the named method, exact): tokens are ordered by frequency (counts of 2^22 hash buckets over
all texts; any order that is the same everywhere is right). Rare tokens are single signatures; frequent
ones fall into hash groups, in which every combination of ``k`` tokens is a signature. A text's prefix
is extended until destroying all its signatures takes more differing tokens than the threshold allows,
so two texts at or over the threshold share a signature.

Copies are one text: they are brought together per partition before the shuffle and by digest after
it; classes and links are computed between different texts only, members come back by a join.

Defined results: null texts and texts under ``least_chars`` take no part; repeated keys count as
further copies; ties do not arise, the test is similarity >= threshold on exact counts.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut, read_table, shuffle_width

WIDTH = 4
THRESHOLD = 0.8
LEAST_CHARS = 200
ORDERS, BANDS = 7, 56  # tokens of a combination, combinations of a text: the same at every size
BITS = 28  # of a combination's 64 bits are a sketch of the rest of the text
AGREE = 23  # of them must agree; a pair at 0.8 passes with 0.95 in each of the combinations it shares
LEAST_TOKENS = 100  # pairs with a text of fewer different tokens are found by prefixes
_MIX = np.random.default_rng(20240417).integers(1, 2**63, size=(16, 4), dtype=np.uint64) | np.uint64(1)


def hashed_tokens(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all substrings of the texts, in order, and the text of each."""
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(t) for t in texts])
    ends = np.cumsum(length)
    doc = np.repeat(np.arange(len(texts)), length)
    h = np.zeros(len(data) - width + 1, np.uint64)
    for i in range(width):
        h = (h ^ data[i : len(data) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = np.arange(len(h)) + width <= ends[doc[: len(h)]]
    return h[inside], doc[: len(h)][inside]


def prefixes(texts: list[str], width: int = WIDTH, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(entries, text of each) of the texts that a pair with fewer than LEAST_TOKENS tokens may hold.

    Two sets at or over the threshold share one of the first n - ceil(threshold n) + 1 of their sorted tokens,
    and their sizes lie in the same or in neighbouring classes. BITS low bits are 0: all entries agree.
    """
    h, doc = hashed_tokens(texts, width)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    sigs, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in range(len(texts)):
        t = np.unique(h[at[i] : at[i + 1]])
        n = len(t)
        if n * threshold >= LEAST_TOKENS:
            continue
        size = int(np.log(n) / -np.log(threshold) + 1e-9) if threshold < 1 else n
        t = t[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
        for c in (size, size + 1):
            u = (t ^ np.uint64(c)) * _MIX[0, 3]
            u ^= u >> np.uint64(32)
            sigs.append((u * _MIX[1, 3]) >> np.uint64(BITS) << np.uint64(BITS))
            of.append(np.full(len(t), i))
    return np.concatenate(sigs), np.concatenate(of)


def combinations(texts: list[str], width: int = WIDTH, orders: int = ORDERS, bands: int = BANDS) -> np.ndarray:
    """uint64[len(texts), bands]: hashed token combinations (upper bits) with BITS low bits, each the
    parity of a least token of another class; texts have >= width characters."""
    h, doc = hashed_tokens(texts, width)
    out = np.zeros((len(texts), bands), np.uint64)
    none = np.uint32(0xFFFFFFFF)
    slot0 = doc * bands
    parity = np.zeros((len(texts), orders, bands), np.uint64)
    for o in range(orders):
        u = h * _MIX[o, 0]
        u ^= u >> np.uint64(32)
        u *= _MIX[o, 1]
        cell = slot0 + (((u >> np.uint64(40)) * np.uint64(bands)) >> np.uint64(24)).astype(np.int64)
        low = np.full(len(texts) * bands, none, np.uint32)
        np.minimum.at(low, cell, (u & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        low = low.reshape(len(texts), bands)
        empty = low == none
        for step in range(1, bands):  # an empty class borrows from the next one that is not
            if not empty.any():
                break
            fill = np.roll(low, -step, axis=1)
            use = empty & (fill != none) & ~np.roll(empty, -step, axis=1)
            low = np.where(use, fill + np.uint32(step * 40503), low)
            empty &= ~use
        parity[:, o] = (low & np.uint32(1)).astype(np.uint64)
        out = (out ^ low.astype(np.uint64)) * _MIX[o, 2]
        out ^= out >> np.uint64(31)
    sketch = np.zeros_like(out)
    band = np.arange(bands)
    for j in range(BITS):
        sketch |= parity[:, j % orders, (band + 1 + j) % bands] << np.uint64(j)
    out = out * np.uint64(bands + 1) + band.astype(np.uint64)
    out ^= out >> np.uint64(33)
    out *= _MIX[orders, 3]
    return (out >> np.uint64(BITS) << np.uint64(BITS)) | sketch


BUCKETS = 1 << 22  # of token counts
RARE = 64  # a token in so many texts at most is a signature of its own
K, GROUP = 3, 3.0  # tokens of a combination of frequent tokens, and how many of a text's a hash group holds on average


def token_frequency(part: DataFrame, width: int) -> np.ndarray:
    """Texts that hold a token of each hash bucket, over all different texts: BUCKETS numbers, whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            h, doc = hashed_tokens(texts, width)
            n += np.bincount(np.unique((doc.astype(np.uint64) << np.uint64(22)) | (h & np.uint64(BUCKETS - 1))) & np.uint64(BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], names=["bucket", "n"])

    t = part.select("text").distinct().mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int32)
    out[t.column("bucket").to_numpy()] = np.minimum(t.column("n").to_numpy(), 2**31 - 1)
    return out


def class_prefixes(texts: list[str], frequency: np.ndarray, width: int = WIDTH, threshold: float = THRESHOLD, k: int = K, group: float = GROUP, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, text of each): rare tokens of the prefix, and k-combinations within hash groups of frequent ones.
    Texts of a few tokens are left to ``prefixes``."""
    h, doc = hashed_tokens(texts, width)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    sigs, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in range(len(texts)):
        t = np.unique(h[at[i] : at[i + 1]])
        n = len(t)
        if n < 4 * k:
            continue
        f = frequency[(t & np.uint64(BUCKETS - 1)).astype(np.int64)]
        o = np.lexsort((t, f))
        t, f = t[o], f[o]
        spare = n - int(np.ceil(threshold * n - 1e-9)) + 1  # differing tokens that the signatures must outlast
        few = int(np.searchsorted(f, rare, side="right"))
        if few >= spare:
            single, frequent = t[:spare], t[:0]
        else:
            single, frequent = t[:few], t[few:]
        out = [single]
        if len(frequent):
            need = spare - few
            size = 1 << max(0, int(np.log2(max(n, 1))))  # texts that can be alike have sizes in this or the next class
            for c in (size, 2 * size) if threshold < 1 else (size,):
                # never so many groups that a text of this class (c / 2 tokens or more) could not outlast the threshold
                groups = max(1, min(int(c * (1 - threshold) * 1.2 / group), int((threshold * c / 2 - 1) / max(k - 1, 1))))
                mix = frequent * _MIX[2, 0]
                g = ((mix ^ (mix >> np.uint64(29))) >> np.uint64(20)) % np.uint64(groups)
                held: dict[int, list[int]] = {}
                lasts = 0
                for x, tok in zip(g.tolist(), frequent.tolist()):
                    v = held.setdefault(x, [])
                    v.append(tok)
                    lasts += len(v) >= k
                    if lasts >= need:
                        break
                combos = [cmb for v in held.values() for cmb in itertools.combinations(sorted(v), k)]
                u = np.array(combos, np.uint64).reshape(-1, k)
                s = np.full(len(u), c, np.uint64)
                for j in range(k):
                    s = (s ^ u[:, j]) * _MIX[3 + j, 0]
                    s ^= s >> np.uint64(31)
                out.append(s)
        sig = np.concatenate(out)
        u = sig * _MIX[1, 3]
        sigs.append((u ^ (u >> np.uint64(32))) >> np.uint64(BITS) << np.uint64(BITS))  # no sketch: all entries agree
        of.append(np.full(len(sig), i))
    return np.concatenate(sigs), np.concatenate(of)


def _index_prefixes(batches: Iterator[pa.RecordBatch], width: int, threshold: float, frequency: np.ndarray) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in batches:
        digest = b.column(0).to_pylist()
        new = [i for i, d in enumerate(digest) if not (d in seen or seen.add(d))]
        if new:
            texts = b.column(1).take(pa.array(new)).to_pylist()
            (sig, of), (few, of_few) = class_prefixes(texts, frequency, width, threshold), prefixes(texts, width, threshold)
            ids = np.array([digest[i] for i in new], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[sig, few].view(np.int64)), pa.array(ids[np.r_[of, of_few]])], names=["sig", "digest"])


def _index(batches: Iterator[pa.RecordBatch], width: int, orders: int, bands: int, threshold: float) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in batches:
        digest = b.column(0).to_pylist()
        new = [i for i, d in enumerate(digest) if not (d in seen or seen.add(d))]
        if new:
            texts = b.column(1).take(pa.array(new)).to_pylist()
            sig = combinations(texts, width, orders, bands)
            few, of = prefixes(texts, width, threshold)
            ids = np.array([digest[i] for i in new], np.int64)
            d = np.r_[np.repeat(ids, sig.shape[1]), ids[of]]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[sig.ravel(), few].view(np.int64)), pa.array(d)], names=["sig", "digest"])


def _pairs_of_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of different digests that share a combination; the partition holds whole combinations."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    sig, dig = (np.concatenate(x) for x in zip(*parts))
    sig = sig.view(np.uint64)
    o = np.argsort(sig, kind="stable")
    sig, dig = sig[o], dig[o]
    key = sig >> np.uint64(BITS)
    at = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    size = np.diff(at)
    for g in np.unique(size[size > 1]):
        first = at[:-1][size == g]
        for lag in range(1, int(g)):  # members lag places apart
            for c in range(0, len(first), max(1, 1_000_000 // int(g))):
                i = (first[c : c + max(1, 1_000_000 // int(g)), None] + np.arange(int(g) - lag)[None, :]).ravel()
                a, b = dig[i], dig[i + lag]
                ok = (a != b) & (np.bitwise_count((sig[i] ^ sig[i + lag]) & np.uint64((1 << BITS) - 1)) <= BITS - AGREE)
                if ok.any():
                    a, b = a[ok], b[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def jaccard(x: str, y: str, width: int = WIDTH) -> float:
    p = {x[i : i + width] for i in range(len(x) - width + 1)}
    q = {y[i : i + width] for i in range(len(y) - width + 1)}
    both = len(p & q)
    return both / (len(p) + len(q) - both) if p or q else 0.0


def similar_texts(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, least_chars: int = LEAST_CHARS, width: int = WIDTH, method: str = "minhash") -> tuple[DataFrame, DataFrame]:
    """(members, links): members (digest, key) of every text that takes part, links (a, b, similarity) between different texts."""
    spark = df.sparkSession
    part = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter(F.length("text") >= max(least_chars, width)).withColumn("digest", F.xxhash64("text"))
    n = shuffle_width(spark)
    if method == "prefix":
        shared = spark.sparkContext.broadcast(token_frequency(part, width))  # BUCKETS numbers
        index = part.select("digest", "text").mapInArrow(lambda it: _index_prefixes(it, width, threshold, shared.value), "sig long, digest long")
    else:
        index = part.select("digest", "text").mapInArrow(lambda it: _index(it, width, ORDERS, BANDS, threshold), "sig long, digest long")
    candidates = (
        index.repartition(n, F.shiftright("sig", BITS)).mapInArrow(_pairs_of_equal, "a long, b long").distinct()
    )
    texts = part.groupBy("digest").agg(F.first("text").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            s = np.array([jaccard(p, q, width) for p, q in zip(x, y)])
            ok = pa.array(s >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(s).filter(ok)], names=["a", "b", "similarity"])

    links = (
        candidates.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("digest").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, similarity double")
    )
    return part.select("digest", "key"), links


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, class_id): the smallest node of each connected component, by hooking and pointer jumping with checkpoints."""
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    label = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")))
    while True:
        near = edges.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        hooked = label.join(near, "u").select("u", F.least("l", "m").alias("n"), "l")
        jumped = hooked.join(hooked.select(F.col("u").alias("n"), F.col("n").alias("nn")), "n", "left").select("u", F.least("n", F.coalesce("nn", "n")).alias("l"), (F.least("n", F.coalesce("nn", "n")) != F.col("l")).alias("moved"))
        nxt = cut(jumped)
        label = nxt.select("u", "l")
        if not nxt.filter("moved").limit(1).count():
            return label.select(F.col("u").alias("node"), F.col("l").alias("class_id"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of chunks at or over the threshold, as TESTDATA.md defines them."""
    members, links = similar_texts(read_table(spark, sf_dir, "chunks").filter("type = 'text'"), "chunk_key", "content")
    between = (
        links.join(members.select(F.col("digest").alias("a"), F.col("key").alias("ka")), "a")
        .join(members.select(F.col("digest").alias("b"), F.col("key").alias("kb")), "b")
        .select(F.least("ka", "kb").alias("chunk_a"), F.greatest("ka", "kb").alias("chunk_b"))
    )
    many = members.join(members.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "digest", "left_semi")
    copies = many.select("digest", F.col("key").alias("chunk_a")).join(many.select("digest", F.col("key").alias("chunk_b")), "digest").filter("chunk_a < chunk_b").select("chunk_a", "chunk_b")
    return between.unionByName(copies)


def p4_groups(spark, sf_dir: str) -> DataFrame:
    """One row per text chunk that takes part: its class, its copies and its links to different texts; nothing is expanded into pairs."""
    members, links = similar_texts(read_table(spark, sf_dir, "chunks").filter("type = 'text'"), "chunk_key", "content")
    links = cut(links)
    classes = components(links)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    texts = (
        members.groupBy("digest").agg(F.count("*").alias("n_copies"), F.min("key").alias("first_key"))
        .join(classes.withColumnRenamed("node", "digest"), "digest", "left").join(degree.withColumnRenamed("node", "digest"), "digest", "left")
        .select("digest", "n_copies", "first_key", F.coalesce("class_id", "digest").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    named = texts.groupBy("class_id").agg(F.min("first_key").alias("group_key"))
    return members.join(texts.join(named, "class_id"), "digest").select(F.col("key").alias("chunk_key"), "group_key", "n_copies", "n_links")
