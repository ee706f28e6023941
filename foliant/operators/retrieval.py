"""Sparse and dense retrieval."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.session import cut

QUERY_BYTES = 256 << 20  # a query set up to this size is sent to every task at once, a larger one goes in blocks
BROADCAST_TERMS = 1_000_000  # weights of up to so many terms go to every task, more are joined by shuffle


def term_frequency(docs: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """(key, term, tf): tokens of each field counted with the field's weight.

    The texts are brought together by key before they are cut into tokens, so the counting itself moves nothing:
    postings are many times the size of the texts.
    """
    def pairs(c: str, w: int):
        return F.transform(tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    weighted = [pairs(c, w) for c, w in fields.items()]
    by_key = docs.select(key, *dict.fromkeys(fields)).repartition(F.col(key))
    one = by_key.select(key, F.explode(weighted[0] if len(weighted) == 1 else F.concat(*weighted)).alias("t"))
    return one.select(key, F.col("t.term").alias("term"), F.col("t.w").alias("w")).groupBy(key, "term").agg(F.sum("w").cast("long").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n_docs: int) -> DataFrame:
    return df.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def term_weights(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf), counted once and written; marked for broadcast if there are ``BROADCAST_TERMS`` at most."""
    w = cut(idf(document_frequency(tf), n_docs).select("term", "idf"))
    return F.broadcast(w) if w.count() <= BROADCAST_TERMS else w


def raw_weights(tf: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    return tf.join(weights, "term").select(key, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("x"))


def normalised(tf: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, term, w): (1 + ln tf) idf, brought to unit length; a zero vector has no rows."""
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))  # rows of a key are together already
    return raw_weights(tf, weights, key).withColumn("norm", norm).filter("norm > 0").select(key, "term", (F.col("x") / F.col("norm")).alias("w"))


def sparse_top(queries: DataFrame, docs: DataFrame, qkey: str, qtext: str, dkey: str, fields: dict[str, int], k: int = 8, least: float = 0.05) -> DataFrame:
    """(qkey, dkey, score, rank): sparse dot products by an equi-join on terms; ties go to the smaller key.

    Terms of the query that no document has weigh nothing and do not enter its norm. Of the documents' postings only those
    of the queries' terms are joined; the others count for the documents' norms, in place.
    """
    tf = term_frequency(docs, dkey, fields)
    weights = term_weights(tf, docs.count())
    q = cut(normalised(term_frequency(queries, qkey, {qtext: 1}), weights, qkey).select(qkey, "term", F.col("w").alias("qw")))
    raw = raw_weights(tf, weights, dkey)
    asked = q.groupBy("term").agg(F.collect_list(F.struct(qkey, "qw")).alias("ask"))
    if q.count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    hit = raw.join(asked, "term", "left")
    # one pass by document: the norm of all its terms and the products with each query
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")))
    found = hit.groupBy(dkey).agg(norm.alias("norm"), F.collect_list(F.when(F.col("ask").isNotNull(), F.struct("x", "ask"))).alias("h")).filter("norm > 0 AND size(h) > 0")
    parts = found.select(dkey, "norm", F.explode("h").alias("h")).select(dkey, "norm", F.col("h.x").alias("x"), F.explode("h.ask").alias("a"))
    score = parts.groupBy(dkey, F.col(f"a.{qkey}").alias(qkey), "norm").agg(F.sum(F.col("x") * F.col("a.qw")).alias("dot")).select(qkey, dkey, F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    rank = W.partitionBy(qkey).orderBy(F.desc("score"), dkey)
    return score.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def dense_top(queries: DataFrame, docs: DataFrame, qkey: str, dkey: str, vector: str, k: int = 5) -> DataFrame:
    """(qkey, dkey, score, rank): exact top-k by cosine. Each task multiplies its rows with a block of the queries and keeps k a query."""
    spark = docs.sparkSession
    q = queries.select(F.col(qkey).cast("long").alias("q"), F.col(vector).alias("v")).filter(F.size("v") > 0)
    size = q.agg(F.sum(8 * (F.size("v") + 2))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    found = None
    for b in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        t = part.toArrow()
        ids = t.column("q").to_numpy()
        x = np.array(t.column("v").to_pylist(), np.float64)
        if not len(x):
            x = np.zeros((0, 1))
        x /= np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12
        shared = spark.sparkContext.broadcast((ids, x))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            best_s = np.full((len(ids), 0), 0.0)
            best_d = np.full((len(ids), 0), 0)
            for batch in batches:
                v = np.array([r for r in batch.column(1).to_pylist()], np.float64)
                if not len(v) or not len(ids):
                    continue
                v /= np.sqrt((v * v).sum(1, keepdims=True)) + 1e-12
                s = np.c_[best_s, np.round(x @ v.T, 6)]
                d = np.c_[best_d, np.broadcast_to(batch.column(0).to_numpy(), (len(ids), len(v)))]
                o = np.lexsort((d, -s), axis=1)[:, :k]
                best_s, best_d = np.take_along_axis(s, o, 1), np.take_along_axis(d, o, 1)
            if best_s.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_s.shape[1])), pa.array(best_d.ravel()), pa.array(best_s.ravel())], names=[qkey, dkey, "score"])

        hits = docs.select(F.col(dkey).cast("long").alias("d"), F.col(vector).alias("v")).filter(F.size("v") > 0).mapInArrow(scan, f"{qkey} long, {dkey} long, score double")
        found = hits if found is None else found.unionByName(hits)
    rank = W.partitionBy(qkey).orderBy(F.desc("score"), dkey)
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def longest_prefix(items: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Adds ``prefix``: the longest one with which the name starts before an underscore; none, or a null name, gives null.

    An equi-join on the leading parts of the different names, so no nested loop is needed; repeated rows stay repeated.
    """
    parts = items.select(F.col(name).alias("n_")).distinct().withColumn("p_", F.explode(F.expr("transform(sequence(1, size(split(n_, '_'))), i -> array_join(slice(split(n_, '_'), 1, i - 1), '_'))")))
    hit = parts.join(prefixes.select(F.col(prefix).alias("p_")).distinct(), "p_").groupBy("n_").agg(F.max_by("p_", F.length("p_")).alias(prefix))
    return items.join(hit, F.col(name) == F.col("n_"), "left").drop("n_")
