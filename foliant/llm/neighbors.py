"""The k most similar vectors of every vector by adaptive dimension scan (problem 2).

Index: spherical k-means cells (``CELLS`` to a block) fitted on a bounded sample (``SAMPLE_ROWS``, the
rows with the smallest hash), every usable row is indexed. Cells are grouped into balanced blocks, one
task each; within its block a second k-means cuts the rows into lists of about ``LIST_ROWS``, so lists
stay short however large the table is. A cell that alone is more than a block is spread over several
blocks by digest, and all of them are asked. A vector travels to the block of its own cell and, as a
query, once to each other block that holds a cell it probes. With ``min_sim`` a cell or list is probed
only if the border towards it is within reach: the step from a vector to a neighbour is at most
sqrt(2 - 2 min_sim) long and, along a given direction, about an eighth of that. ``ROUTE_REACH`` standard
deviations are allowed on the way to blocks, where a pair is found from either side, ``REACH`` inside.

Vectors are rotated by a random orthogonal matrix and scanned in column blocks: after each block a
hypothesis test compares the partial distance, scaled by 64/d, with the query's threshold and abandons
the candidate; few survivors go on as pairs, many as a dense block. The threshold is the k-th best so
far, or ``min_sim`` where only near vectors count. What is left is scored in double precision on the
vectors as stored.

Exact copies of a vector are brought to one row per input partition before the shuffle and to one per
block after it; their ids come back by a join on the vector's 128-bit digest, at most k + 1 of them
where they are neighbours, so a vector that a third of the rows repeat costs one search.

Defined results: vectors that are null, empty, of another length, all zero or not finite take no
part; the own row is never a neighbour; among copies ties (in six digits) go to the smaller id, among
different vectors at the k-th place to any; fewer than k others give fewer rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.session import cut, read_table

DIM = 64
COLUMNS = 16
LIST_ROWS = 256
BLOCK_ROWS = 65_536
LEAST_BLOCKS = 12
CELLS = 8
SAMPLE_ROWS = 65_536
MAX_CELLS = SAMPLE_ROWS // 4  # what the sample can tell apart; beyond, cells hold more rows and are spread over blocks
EPSILON = 2.1  # of the hypothesis test
ROUTE_REACH, REACH = 1.25, 2.5
FULL_BLOCKS, FULL_ROWS = 200, 1_000_000  # blocks, or rows of a block, where every list is probed


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors and the vectors as stored."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy()
    n = np.diff(off)
    ok = np.flatnonzero((n == dim) & ~np.asarray(col.is_null()))
    if not len(ok):
        return ok, np.zeros((0, dim), np.float32)
    v = col.values.to_numpy(zero_copy_only=False)
    x = v[off[ok][:, None] + np.arange(dim)].astype(np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return ok[good], x[good] + np.float32(0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Of unit length, in double precision; the largest number is divided out first, so nothing overflows."""
    y = x.astype(np.float64)
    if len(y):
        y /= np.abs(y).max(1, keepdims=True)
        y /= np.sqrt((y * y).sum(1, keepdims=True))
    return y


def _digests(x: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(v) for v in np.ascontiguousarray(x)]


def _binary(values: np.ndarray, length: np.ndarray) -> pa.Array:
    """Binary array whose items are the next ``length`` bytes of the values."""
    off = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes_of(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    c = col.combine_chunks()
    if isinstance(c, pa.ChunkedArray):
        c = c.chunk(0) if c.num_chunks else pa.array([], pa.binary())
    _, off, data = c.buffers()
    off = np.frombuffer(off, np.int32)[c.offset : c.offset + len(c) + 1] if off is not None and len(c) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]), np.float32)
    for _ in range(rounds if len(x) else 0):
        a = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        o = np.argsort(a, kind="stable")
        u, at = np.unique(a[o], return_index=True)
        s = np.add.reduceat(x[o], at, axis=0)
        c[u] = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-9)
    return c


def group_lists(c: np.ndarray, weight: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each list: halves along the main direction, balanced by weight."""
    out = np.zeros(len(c), np.int32)

    def halve(idx: np.ndarray, first: int, n: int) -> None:
        if n <= 1 or len(idx) <= 1:
            out[idx] = first
            return
        x = c[idx] - c[idx].mean(0)
        d = np.linalg.svd(x, full_matrices=False)[2][0] if len(idx) > 1 else x[0]
        o = idx[np.argsort(x @ d, kind="stable")]
        w = np.cumsum(weight[o])
        a = n // 2
        k = min(max(int(np.searchsorted(w, w[-1] * a / n)), 1), len(o) - 1)
        halve(o[:k], first, a)
        halve(o[k:], first + a, n - a)

    halve(np.arange(len(c)), 0, blocks)
    return out


def scan_lists(base: np.ndarray, start: np.ndarray, query: np.ndarray, pair_q: np.ndarray, pair_l: np.ndarray, k: int, min_sim: float | None, epsilon: float = EPSILON):
    """Candidates (query, base row, similarity) of all (query, list) pairs; rows of list l are start[l]:start[l+1].

    A query's first pair sets its threshold when there is no ``min_sim``.
    """
    dim = base.shape[1]
    cuts = list(range(0, dim, COLUMNS)) + [dim]
    parts_q = [np.ascontiguousarray(query[:, a:b]) for a, b in zip(cuts, cuts[1:])]
    parts_b = [np.ascontiguousarray(base[:, a:b]) for a, b in zip(cuts, cuts[1:])]
    norm_q = np.cumsum([(p * p).sum(1) for p in parts_q], axis=0)
    norm_b = np.cumsum([(p * p).sum(1) for p in parts_b], axis=0)
    thr = np.full(len(query), -1.0 if min_sim is None else min_sim, np.float32)
    out_q, out_b, out_s = [], [], []

    def one(lst: int, qs: np.ndarray) -> None:
        lo, hi = start[lst], start[lst + 1]
        if lo == hi or not len(qs):
            return
        far = (2 - 2 * thr[qs]).astype(np.float32)
        dense, i, j, acc = np.zeros((len(qs), hi - lo), np.float32), None, None, None
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            last = b == dim
            allow = far * (b / dim) * (1.0 if last else (1 + epsilon / math.sqrt(b)) ** 2) + (1e-5 if last else 0)
            if i is None:
                dense += parts_q[s][qs] @ parts_b[s][lo:hi].T
                keep = dense >= (norm_q[s][qs] - allow)[:, None] / 2 + norm_b[s][lo:hi][None, :] / 2
                if last or np.count_nonzero(keep) < 0.1 * keep.size:
                    i, j = np.nonzero(keep)
                    acc = dense[i, j]
            else:
                acc = acc + np.einsum("ij,ij->i", parts_q[s][qs[i]], parts_b[s][lo + j])
                ok = norm_q[s][qs[i]] + norm_b[s][lo + j] - 2 * acc <= allow[i]
                i, j, acc = i[ok], j[ok], acc[ok]
            if i is not None and not len(i):
                return
        out_q.append(qs[i])
        out_b.append(lo + j)
        out_s.append(acc)

    def by_list(qs: np.ndarray, ls: np.ndarray) -> None:
        o = np.argsort(ls, kind="stable")
        u, at = np.unique(ls[o], return_index=True)
        for n, (lst, a) in enumerate(zip(u, at)):
            mine = qs[o[a : at[n + 1] if n + 1 < len(at) else len(o)]]
            step = max(1, 4_000_000 // max(1, start[lst + 1] - start[lst]))
            for c in range(0, len(mine), step):
                one(int(lst), mine[c : c + step])

    if min_sim is None:
        first = np.unique(pair_q, return_index=True)[1]
        by_list(pair_q[first], pair_l[first])
        q0, b0, s0 = best(out_q, out_b, out_s, k + 1)
        out_q[:], out_b[:], out_s[:] = [q0], [b0], [s0]
        kth = np.full(len(query), -1.0, np.float32)
        n_of = np.bincount(q0, minlength=len(query))
        np.minimum.at(filled := np.full(len(query), 2.0, np.float32), q0, s0)
        kth[n_of >= k + 1] = filled[n_of >= k + 1]
        thr = kth
        rest = np.ones(len(pair_q), bool)
        rest[first] = False
        pair_q, pair_l = pair_q[rest], pair_l[rest]
    by_list(pair_q, pair_l)
    return best(out_q, out_b, out_s, k + 1)


def best(out_q: list, out_b: list, out_s: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query; the query itself may be one, so callers ask for one more."""
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    q, b, s = np.concatenate(out_q), np.concatenate(out_b), np.concatenate(out_s)
    o = np.lexsort((b, -s, q))
    q, b, s = q[o], b[o], s[o]
    at = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(at, np.diff(np.r_[at, len(q)])) if len(q) else np.zeros(0, int)
    return q[rank < k], b[rank < k], s[rank < k]


def probed(sim: np.ndarray, near: np.ndarray, cents: np.ndarray, home: np.ndarray, min_sim: float | None, reach: float) -> np.ndarray:
    """Which of the ``near`` cells of each row are looked into: all, or those whose border is within reach."""
    if min_sim is None:
        return np.ones(near.shape, bool)
    step = reach * math.sqrt(max(2 - 2 * min_sim, 0.0) / cents.shape[1])
    own = np.take_along_axis(sim, home[:, None], 1)
    apart = np.sqrt(np.maximum(2 - 2 * np.einsum("nkd,nd->nk", cents[near], cents[home]), 1e-9))
    return (own - np.take_along_axis(sim, near, 1) <= step * apart) | (near == home[:, None])


def _closest(x: np.ndarray, cents: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(similarity to all, closest, the n closest in order) of each row."""
    sim = x @ cents.T
    near = np.argpartition(-sim, n - 1, axis=1)[:, :n] if n < sim.shape[1] else np.tile(np.arange(sim.shape[1]), (len(sim), 1))
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
    return sim, sim.argmax(1), near


def lists_of(base: np.ndarray, query: np.ndarray, probes: int | None, min_sim: float | None):
    """Lists of the rows of a block: (list of each row, number of lists, pairs of query and list, the closest list first)."""
    some = base[:: max(1, len(base) // SAMPLE_ROWS)]
    cents = fit_centroids(some, max(1, len(base) // LIST_ROWS), rounds=4)
    lists = np.concatenate([(base[c : c + 8192] @ cents.T).argmax(1) for c in range(0, len(base), 8192)])
    most = len(cents) if probes is None else min(len(cents), 4 * probes)
    out_q, out_l = [], []
    for c in range(0, len(query), 4096):
        sim, own, near = _closest(query[c : c + 4096], cents, most)
        q, k = np.nonzero(probed(sim, near, cents, own, min_sim, REACH))
        out_q.append(c + q)
        out_l.append(near[q, k])
    return lists, len(cents), np.concatenate(out_q), np.concatenate(out_l)


def nearest(
    df: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = 12, min_sim: float | None = None,
    query_filter: str | None = None, dim: int = DIM, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(vec_id, neighbor, similarity): up to k nearest others of each query row by cosine.

    At most ``probes`` cells are looked into for each query, None means all of them (for a small query set);
    ``query_filter`` is a SQL condition on the key.
    """
    spark = df.sparkSession
    src = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    usable = src.filter(F.size("v") == dim)
    total = usable.count()
    blocks = max(LEAST_BLOCKS, math.ceil(total / BLOCK_ROWS))
    if probes is None:  # every query goes to every block
        blocks = min(blocks, max(FULL_BLOCKS, math.ceil(total / FULL_ROWS)))
    cells = max(1, min(MAX_CELLS, CELLS * blocks, total // 16))
    want = min(sample_rows, 32 * cells)
    share = min(1.0, 1.3 * want / max(total, 1))
    sample = usable.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * want).toArrow()
    x = _unit(_matrix(sample.column("v"), dim)[1]).astype(np.float32)
    turn = rotation(dim)
    x = x @ turn
    cents = fit_centroids(x, cells)
    weight = np.ones(len(cents))
    for i in range(0, len(x), 4096):
        weight += np.bincount((x[i : i + 4096] @ cents.T).argmax(1), minlength=len(cents))
    rows = weight * total / weight.sum()  # expected in each cell
    parts = np.maximum(1, np.ceil(rows / (2 * BLOCK_ROWS))).astype(np.int32)
    if probes is None:
        parts[:] = 1
    block_of = group_lists(cents, np.where(parts > 1, 1e-9, weight), blocks)
    first = blocks + np.cumsum(np.r_[0, parts[parts > 1]])  # cells larger than a block get blocks of their own
    block_of[parts > 1] = first[:-1]
    n_blocks = int(first[-1])
    shared = spark.sparkContext.broadcast((cents, block_of, parts, turn))  # at most MAX_CELLS x dim floats
    probe_n = min(probes or 1, len(cents))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, block_of, parts, turn = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            ok, raw = _matrix(batch.column(1), dim)
            if not len(ok):
                continue
            digest = _digests(raw)
            asked = np.asarray(batch.column(2))[ok]
            fresh = np.array([not ((d, a) in seen or seen.add((d, a))) for d, a in zip(digest, asked.tolist())], bool)
            if not fresh.any():
                continue
            at = np.flatnonzero(fresh)
            raw, asked = raw[at], asked[at]
            ids = np.frombuffer(b"".join(digest[i] for i in at), np.uint8).reshape(-1, 16)
            salt = ids[:, 0].astype(np.int32) << 16 | ids[:, 1].astype(np.int32) << 8 | ids[:, 2]
            x = (_unit(raw) @ turn).astype(np.float32)
            for a in range(0, len(x), 4096):
                y = x[a : a + 4096]
                sim, home, near = _closest(y, cents, probe_n)
                keep = probed(sim, near, cents, home, min_sim, ROUTE_REACH) & asked[a : a + 4096, None]
                r, j = np.nonzero(keep)
                cell = near[r, j]
                r, cell = np.repeat(r, parts[cell]), np.repeat(cell, parts[cell])
                one = np.r_[True, (r[1:] != r[:-1]) | (cell[1:] != cell[:-1])] if len(r) else np.zeros(0, bool)
                nth = np.arange(len(r)) - np.maximum.accumulate(np.where(one, np.arange(len(r)), 0)) if len(r) else r
                block = block_of[cell] + nth
                if probes is None:
                    some = np.flatnonzero(asked[a : a + 4096])
                    r, block = np.repeat(some, n_blocks), np.tile(np.arange(n_blocks), len(some))
                own = block_of[home] + salt[a : a + 4096] % parts[home]
                # one row per (vector, block): kind 1 is in the block, 2 asks there, 3 both
                to = np.unique(np.r_[np.arange(len(y)) * n_blocks + own, r * n_blocks + block])
                row, blk = to // n_blocks, to % n_blocks
                kind = (blk == own[row]).astype(np.int32) + 2 * asked[a : a + 4096][row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blk.astype(np.int32)), _binary(ids[a : a + 4096][row], np.full(len(row), 16)), pa.array(kind.astype(np.int8)), _binary(raw[a : a + 4096][row], np.full(len(row), 4 * dim))],
                    names=["block", "digest", "kind", "vec"],
                )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = _matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(_digests(x), pa.binary()), b.column(0).take(pa.array(ok))], names=["digest", "vec_id"])

    def search(table: pa.Table) -> pa.Table | None:
        turn = shared.value[3]
        kind = table.column("kind").to_numpy()
        ids = _bytes_of(table.column("digest"))[1].reshape(-1, 16)
        raw = _bytes_of(table.column("vec"))[1].view(np.float32).reshape(-1, dim)
        number = np.unique(np.ascontiguousarray(ids).view("V16").ravel(), return_inverse=True)[1].ravel()  # of each different vector
        at, ask = np.flatnonzero(kind & 1), np.flatnonzero(kind & 2)
        at = at[np.unique(number[at], return_index=True)[1]]
        ask = ask[np.unique(number[ask], return_index=True)[1]]
        if not len(ask) or not len(at):
            return None
        exact_b, exact_q = _unit(raw[at]), _unit(raw[ask])
        base, query = (exact_b @ turn).astype(np.float32), (exact_q @ turn).astype(np.float32)
        lists, n, pair_q, pair_l = lists_of(base, query, probes, min_sim)
        o = np.argsort(lists, kind="stable")
        start = np.searchsorted(lists[o], np.arange(n + 1))
        q, b, _ = scan_lists(base[o], start, query, pair_q, pair_l, k, min_sim)
        b = o[b]
        s = np.einsum("ij,ij->i", exact_q[q], exact_b[b])
        other = number[ask[q]] != number[at[b]]
        if min_sim is not None:
            other &= s >= min_sim
        q, b, s = ask[q[other]], at[b[other]], s[other]
        if min_sim is not None and query_filter is None:  # a pair counts for both
            q, b, s = np.r_[q, b], np.r_[b, q], np.r_[s, s]
        full = np.full(len(q), 16)
        return pa.table({"q": _binary(ids[q], full), "b": _binary(ids[b], full), "s": pa.array(s)})

    asked = F.lit(True) if query_filter is None else F.coalesce(F.expr(query_filter.replace(key, "vec_id")), F.lit(False))
    routed = src.select("vec_id", "v", asked.alias("asked")).mapInArrow(place, "block int, digest binary, kind byte, vec binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds one block."""
        got = list(batches)
        found = search(pa.Table.from_batches(got)) if got else None
        if found is not None:
            yield from found.to_batches(max_chunksize=65_536)

    found = routed.repartitionById(n_blocks, "block").mapInArrow(task, "q binary, b binary, s double")
    # both sides may have found a pair, so up to two rows stand for one neighbour
    few = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "b"))).filter(F.col("r") <= 2 * k).drop("r").distinct()
    top = few.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round("s", 6)), "b"))).filter(F.col("r") <= k).drop("r")
    members = cut(usable.select("vec_id", "v").mapInArrow(digests, "digest binary, vec_id long"))
    return _with_copies(members, top, k, query_filter.replace(key, "vec_id") if query_filter else None)


def _with_copies(members: DataFrame, top: DataFrame, k: int, query_filter: str | None) -> DataFrame:
    """Neighbours between digests -> neighbours between ids; the k + 1 smallest ids stand for a digest's copies."""
    first = members.withColumn("r", F.row_number().over(W.partitionBy("digest").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    copies = first.groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most k + 1
    across = top.join(copies.select(F.col("digest").alias("b"), "ids"), "b").groupBy("q").agg(F.collect_list(F.struct("s", "ids")).alias("near")).withColumnRenamed("q", "digest")
    lone = copies.filter(F.size("ids") > 1).select("digest", F.col("ids").alias("own"))
    lists = across.join(lone, "digest", "full_outer").select("digest", F.expr(
        "concat(transform(coalesce(own, array()), i -> named_struct('o', -1D, 'id', i, 's', 1D)),"
        " flatten(transform(coalesce(near, array()), n -> transform(n.ids, i -> named_struct('o', -round(n.s, 6), 'id', i, 's', n.s)))))"
    ).alias("c")).withColumn("c", F.expr(f"slice(array_sort(c), 1, {k + 1})"))
    ask = members.filter(query_filter) if query_filter else members
    return (
        ask.join(lists, "digest")
        .select("vec_id", F.expr(f"slice(filter(c, x -> x.id <> vec_id), 1, {k})").alias("c"))
        .select("vec_id", F.explode("c").alias("x"))
        .select("vec_id", F.col("x.id").alias("neighbor"), F.col("x.s").alias("similarity"))
    )


def p2_found(spark, sf_dir: str, least: float = 0.90, k: int = 10) -> DataFrame:
    near = nearest(read_table(spark, sf_dir, "embed_response"), "vec_id", "dense", k=k, min_sim=least)
    return near.select(F.least("vec_id", "neighbor").alias("vec_a"), F.greatest("vec_id", "neighbor").alias("vec_b")).distinct()


def p2_neighbors(spark, sf_dir: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows; all lists are probed."""
    near = nearest(read_table(spark, sf_dir, "embed_response"), "vec_id", "dense", k=k, probes=probes, query_filter="vec_id % 100 = 0")
    return near.withColumn("similarity", F.round("similarity", 6))
