"""Registration of queries: a callable over (spark, sf_dir) and, where there is one, SQL for another engine."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.session import read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings leaflets chunks to_description "
    "page_features embed_requests embed_response drug_catalogue glossary"
).split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function as a query; ``sql`` states the same for the checking engine."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the driver tables it names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is one SQL statement; the same text serves both engines unless ``oracle`` differs."""
    QUERIES[name] = lambda spark, sf_dir: spark_sql(spark, sf_dir, text)
    ORACLE[name] = oracle or text
