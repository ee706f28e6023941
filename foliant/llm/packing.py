"""Filling containers of fixed capacity with texts (problem 7).

Sizes are tokens of a public tokenizer. Items are dealt by hash to shards of about ``SHARD_ITEMS``, one
task each. The length histogram of a shard (classes of ``GRAIN`` tokens) gives a configuration linear
program: fewest containers, each filled by one configuration, so that every class is covered. It is
solved by multiplicative weights; each step prices the best configuration by a knapsack dynamic program
that never takes more of a class than there is. The fractional solution is rounded down, the program is
solved again for the demand that is left, and so on until nothing whole comes out; then the best
configurations are taken once more as long as the demand holds a whole one. What is left is placed
best-fit in decreasing order, and short texts (under ``SAND``, they are not in the program) fill the
slack of all containers. If best-fit alone needs fewer containers for a shard, that result is taken.

Defined results: a text longer than the capacity is cut into full pieces and a rest, no other text
is cut; null and empty texts take no space and go into the first container of their shard; one row
per piece; an empty table gives no rows.
"""
from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.tokens import DEFAULT_VOCAB, encode_corpus
from foliant.session import cut, read_table

CAPACITY = 8192
GRAIN = 32  # tokens a class is wide; classes are rounded up, so a configuration always fits
SAND = 256  # shorter texts are not in the program, they fill slack
SHARD_ITEMS = 25_000
STEPS, ROUNDS = 120, 4


def best_configuration(width: np.ndarray, worth: np.ndarray, limit: np.ndarray, room: int) -> np.ndarray:
    """Knapsack by dynamic programming: counts per class, at most ``limit`` each, that are worth most within ``room`` units."""
    f = np.zeros(room + 1)
    took = np.zeros((len(width), room + 1), np.int16)
    for i, (w, v) in enumerate(zip(width.tolist(), worth.tolist())):
        best, count = f.copy(), took[i]
        for m in range(1, min(int(limit[i]), room // w) + 1):
            other = f[: room + 1 - m * w] + m * v
            better = other > best[m * w :] + 1e-12
            best[m * w :][better] = other[better]
            count[m * w :][better] = m
        f = best
    counts, c = np.zeros(len(width), np.int64), room
    for i in range(len(width) - 1, -1, -1):
        counts[i] = took[i, c]
        c -= int(counts[i] * width[i])
    return counts


def solve_program(width: np.ndarray, demand: np.ndarray, room: int, eps: float = 0.5, steps: int = STEPS) -> list[tuple[np.ndarray, float]]:
    """Fractional covering by multiplicative weights; [(counts per class, number of containers)], most containers first."""
    weight = width / room
    covered = np.zeros(len(width))
    used: dict[bytes, list] = {}
    for _ in range(steps):
        conf = best_configuration(width, weight, demand, room)
        hit = conf > 0
        if not hit.any():
            break
        step = float((demand[hit] / conf[hit]).min())
        rate = step * conf / demand
        covered += rate
        used.setdefault(conf.tobytes(), [conf, 0.0])[1] += step
        weight = weight * np.exp(-eps * rate)
        weight /= weight.max()
    reached = covered[covered > 0]
    scale = max(float(reached.min()), 1.0) if len(reached) == len(covered) else max(float(np.median(reached)), 1.0) if len(reached) else 1.0
    return sorted(((c, x / scale) for c, x in used.values()), key=lambda t: -t[1])


def whole_solution(width: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """[(counts per class, whole number of containers)] that never asks for more than the demand."""
    left, out, seen = demand.astype(np.int64).copy(), [], {}

    def take(conf: np.ndarray, copies: int, on: np.ndarray) -> int:
        full = np.zeros(len(width), np.int64)
        full[on] = conf
        hit = full > 0
        copies = min(copies, int((left[hit] // full[hit]).min()))
        if copies > 0:
            left[:] -= copies * full
            out.append((full, copies))
            seen[full.tobytes()] = full
        return max(copies, 0)

    for _ in range(rounds):
        on = np.flatnonzero(left > 0)
        if not len(on):
            break
        program = solve_program(width[on], left[on].astype(float), room)
        if not sum([take(c, math.floor(x + 1e-9), on) for c, x in program]):
            break
    every = np.arange(len(width))
    for full in sorted(seen.values(), key=lambda c: -int((c * width).sum())):
        if int((full * width).sum()) >= room - 1:  # a full configuration cannot be bettered
            take(full, 1 << 40, every)
    return out


def best_fit(order: np.ndarray, size: np.ndarray, where: np.ndarray, free: list[int], capacity: int) -> None:
    """Places what has no container yet, in the given order, where least room is left."""
    slack = sorted((room, b) for b, room in enumerate(free))
    for i in order.tolist():
        n = int(size[i])
        if where[i] >= 0 or n == 0:
            continue
        k = bisect_left(slack, (n, -1))
        if k < len(slack):
            room, b = slack.pop(k)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        where[i] = b
        free[b] = room - n
        if free[b]:
            insort(slack, (free[b], b))


def pack_shard(ids: np.ndarray, piece: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """Container number (from 0) of each item of one shard."""
    order = np.lexsort((piece, ids, -size))
    plain, alone = np.full(len(ids), -1, np.int64), []
    best_fit(order, size, plain, alone, capacity)
    room = capacity // GRAIN
    klass = -(-size // GRAIN)
    big = order[(size[order] >= SAND) & (klass[order] <= room)]
    where, free = np.full(len(ids), -1, np.int64), []
    if len(big) and len(alone) > 1:
        width, demand = np.unique(klass[big], return_counts=True)
        stock = {w: big[klass[big] == w].tolist() for w in width.tolist()}
        for conf, copies in whole_solution(width, demand, room):
            hit = [(int(width[k]), int(conf[k])) for k in np.flatnonzero(conf)]
            for _ in range(copies):
                left = capacity
                for w, m in hit:
                    for _ in range(m):
                        i = stock[w].pop()
                        where[i] = len(free)
                        left -= int(size[i])
                free.append(left)
    best_fit(order, size, where, free, capacity)
    if len(free) > len(alone):
        where = plain
    where[where < 0] = 0
    return where


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, n_tokens) -> (doc_id, piece_no, start_token, n_tokens, container_id)."""
    pieces = sizes.select(
        "doc_id",
        F.posexplode(F.expr(
            f"transform(sequence(0, int(greatest(n_tokens - 1, 0) / {capacity})), i -> least({capacity}, n_tokens - i * {capacity}))"
        )).alias("piece_no", "n_tokens"),
    ).withColumn("start_token", F.col("piece_no") * F.lit(capacity))
    shards = max(1, math.ceil(pieces.count() / shard_items))

    def one(table: pa.Table) -> pa.Table:
        ids, piece, size = (table.column(c).to_numpy() for c in ("doc_id", "piece_no", "n_tokens"))
        ids = np.where(np.isnan(ids), -1, ids).astype(np.int64) if ids.dtype.kind == "f" else ids
        at = pack_shard(ids, piece, size, capacity)
        shard = int(table.column("shard")[0].as_py())
        return table.drop_columns(["shard"]).append_column("container_id", pa.array(at + (shard << 32), pa.int64()))

    return (
        pieces.select("doc_id", "piece_no", F.col("start_token").cast("int").alias("start_token"), F.col("n_tokens").cast("int").alias("n_tokens"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(one, "doc_id long, piece_no int, start_token int, n_tokens int, container_id long")
    )


def p7_containers(spark, sf_dir: str, capacity: int = CAPACITY, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    sizes = encode_corpus(read_table(spark, sf_dir, "documents"), vocab=vocab, count_only=True)
    return pack(cut(sizes), capacity)
