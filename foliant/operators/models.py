"""External models behind batch functions: error isolation, fallback, fusion, deterministic stand-ins."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.calls import Policy, call

Model = Callable[[list], list]


def batch_call(df: DataFrame, key: str, value: str, model: Model, retries: int = 2, policy: Policy | None = None) -> DataFrame:
    """(key, ok, data, error): one call per Arrow batch under the policy; where a batch fails for good its items are called
    one by one, each under the policy, so one bad item never takes others with it. A failure that waiting may mend (SAFE,
    UNKNOWN) is tried again with doubled waits, for the batch as for an item; others are not."""
    policy = policy or Policy(attempts=retries + 1, base_s=0.05)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(vals: list) -> list:
            got = model(vals)
            if len(got) != len(vals):
                raise ValueError("length")
            return got

        for b in batches:
            vals = b.column(1).to_pylist()
            r = call(whole, vals, policy=policy)
            if r.ok:
                rows = [(True, x, None) for x in r.data]
            elif len(vals) == 1:
                rows = [(False, None, r.error)]
            else:
                rows = [(o.ok, o.data[0] if o.ok else None, o.error) for o in (call(whole, [v], policy=policy) for v in vals)]
            ok, data, err = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_()), pa.array(data, pa.string()), pa.array(err, pa.string())], names=[key, "ok", "data", "error"])

    return df.select(key, value).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, ok boolean, data string, error string")


def cached_call(df: DataFrame, key: str, value: str, cache: DataFrame, model: Model) -> DataFrame:
    """As batch_call, but each different value is called once and values in ``cache`` (h, data) not at all."""
    h = F.sha2(F.col(value).cast("string"), 256)
    x = df.withColumn("h", h)
    todo = x.select("h", value).dropDuplicates(["h"]).join(cache.select("h"), "h", "left_anti")
    fresh = batch_call(todo, "h", value, model)
    known = fresh.unionByName(cache.select("h", F.lit(True).alias("ok"), "data", F.lit(None).cast("string").alias("error")))
    return x.select(key, "h").join(known, "h", "left").select(key, "ok", "data", "error")


def fuse(ocr_ok: Column, ocr: Column, vlm_ok: Column, vlm: Column, decision: Column) -> tuple[Column, Column]:
    """(engine, text) from both channels: vlm falls back to ocr, hybrid merges what there is."""
    engine = (
        F.when(decision == "vlm", F.when(vlm_ok, "vlm").when(ocr_ok, "ocr(fallback)"))
        .when(decision == "ocr", F.when(ocr_ok, "ocr"))
        .otherwise(F.when(ocr_ok & vlm_ok, "hybrid").when(vlm_ok, "vlm(fallback)").when(ocr_ok, "ocr(fallback)"))
    )
    text = F.when(engine == "hybrid", F.concat_ws("\n", ocr, vlm)).when(engine.startswith("vlm"), vlm).when(engine.isNotNull(), ocr)
    return F.coalesce(engine, F.lit("none")), text


def stub_embedding(text: str | None, dim: int = 16) -> list[float] | None:
    """A deterministic unit vector of a text's bytes; blank texts have none."""
    if text is None or not text.strip():
        return None
    raw = hashlib.shake_256(text.encode()).digest(4 * dim)
    v = np.frombuffer(raw, np.uint32).astype(np.float64) / 2**32 - 0.5
    return (v / np.linalg.norm(v)).astype(np.float32).tolist()


def embed(df: DataFrame, key: str, text: str, fn: Callable[[str | None], list[float] | None] = stub_embedding) -> DataFrame:
    """(key, embedding): index rows of texts that are not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fn(t) for t in b.column(1).to_pylist()], pa.list_(pa.float32()))], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>").filter("embedding IS NOT NULL")
