"""Sinks: JSON, Markdown, HTML, vector store, cache and round log."""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import html_escape, page_range


def layout_json(chunks: DataFrame, key: str) -> DataFrame:
    """(key, json): whole chunks of a document, each with its meta, as one JSON array in order; nulls are left out."""
    cols = ["id", "type", "section", "sub_section", "caption", "content", "page_start", "page_end", "char_len", "meta"]
    return chunks.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).alias("json"))


def chunk_line() -> Column:
    sub = F.when(F.coalesce("sub_section", F.lit("")) != "", F.concat(F.lit(" > "), F.col("sub_section"))).otherwise("")
    return F.concat(F.lit("- "), F.col("id"), F.lit(" ["), F.col("type"), F.lit("] "), F.coalesce("section", F.lit("")), sub, F.lit(" "), F.coalesce(page_range(F.col("page_start"), F.col("page_end")), F.lit("")))


def chunks_markdown(chunks: DataFrame, key: str) -> DataFrame:
    """(key, md): a head with the counts by type, then a line per chunk."""
    lines = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "chunk_key", chunk_line().alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    n = chunks.groupBy(key, "type").agg(F.count("*").alias("n")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat(x["type"], F.lit("="), x["n"])), ", ").alias("head"))
    return lines.join(n, key).select(key, F.concat(F.lit("# chunks: "), F.col("head"), F.lit("\n"), F.col("body")).alias("md"))


def report_html(chunks: DataFrame, key: str) -> DataFrame:
    """(key, html): a table row per chunk, every value escaped."""
    td = lambda c: F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c), F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), td("id"), td("section"), td("content"), F.lit("</tr>"))
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_key", row.alias("r")))), lambda x: x["r"]), "").alias("html"))


def write_vectors(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def read_vectors(spark, path: str) -> DataFrame:
    if not os.path.exists(path) and "://" not in path:
        raise FileNotFoundError(f"no vector store at {path}; build the index first")
    return spark.read.parquet(path)


def put_cache(spark, path: str, new: DataFrame) -> None:
    """Appends (key, version, value, expire_at, written_at)."""
    new.write.mode("append").parquet(path)


def get_cache(spark, path: str, version: str, now: Column) -> DataFrame:
    """Newest live entry of each key under a version; expire_at null never ends."""
    c = spark.read.parquet(path).filter((F.col("version") == version) & (F.col("expire_at").isNull() | (F.col("expire_at") >= now)))
    return c.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("written_at")))).filter("r = 1").drop("r")


def append_rounds(rounds: DataFrame, path: str) -> None:
    """A JSON line per round."""
    rounds.write.mode("append").json(path)


def write_tables(tables: DataFrame, path: str) -> None:
    """One Markdown text per table id, caption first."""
    tables.select("id", F.concat_ws("\n\n", F.col("caption"), F.col("md")).alias("value")).write.mode("overwrite").partitionBy("id").text(path)


def write_figures(figures: DataFrame, path: str) -> None:
    """Bytes of (id, ext, image) into files, written by the tasks; rows without bytes write nothing."""
    os.makedirs(path, exist_ok=True)

    def save(rows):
        for r in rows:
            if r["image"] is not None:
                tmp = os.path.join(path, f".{r['id']}.{r['ext']}.tmp")
                with open(tmp, "wb") as f:
                    f.write(r["image"])
                os.replace(tmp, os.path.join(path, f"{r['id']}.{r['ext']}"))  # a repeated task leaves the same file

    figures.select("id", "ext", "image").foreachPartition(save)
