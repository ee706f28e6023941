"""Sources: driver tables, layout files, directories of outputs, environment files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = "meta map<string,string>, chunks array<struct<id: string, type: string, section: string, sub_section: string, caption: string, content: string, page_start: int, page_end: int, char_len: int>>"


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk of layout.json files; unknown keys are dropped, missing ones are null."""
    return spark.read.schema(LAYOUT).json(path, multiLine=True).select(F.col("meta")["doc_id"].alias("doc_id"), F.explode("chunks").alias("c")).select("doc_id", "c.*")


def newest_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(stem, path): the newest file per stem, those that carry the stem in their name first."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    stem = F.regexp_extract("path", r"([^/]+?)(?:_content_list)?\.[a-z]+$", 1)
    return f.withColumn("stem", stem).groupBy("stem").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of KEY=value lines; comments and lines without = are skipped, quotes are stripped.

    A settings file belongs to the driver and its name is often hidden, which file sources skip.
    """
    with open(path, encoding="utf-8") as f:
        lines = spark.createDataFrame([(x.rstrip("\n"),) for x in f], "value string")
    line = lines.filter(F.col("value").contains("=") & ~F.trim("value").startswith("#"))
    kv = F.split("value", "=", 2)
    return line.select(F.trim(kv[0]).alias("key"), F.regexp_replace(F.trim(kv[1]), "^[\"']|[\"']$", "").alias("value"))


def read_files(spark: SparkSession, path: str, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(accepted with sha256, rejected) files; the size filter reaches the file listing."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.filter(F.col("length") <= max_bytes).withColumn("sha256", F.sha2("content", 256)), f.filter(F.col("length") > max_bytes).select("path", "length")
