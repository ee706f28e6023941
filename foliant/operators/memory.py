"""Conversation memory: turns from chat texts and windows over them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

USER = "^(user|用户|Nutzer|utilisateur|usuario) ?[:：] ?"
ASSISTANT = "^(assistant|助手|Assistent|asistente) ?[:：] ?"


def turns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, turn, role, content): one row per line that a speaker label opens, numbered from 1."""
    line = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    role = F.when(F.col("line").rlike(USER), "user").when(F.col("line").rlike(ASSISTANT), "assistant")
    said = line.withColumn("role", role).filter("role IS NOT NULL").withColumn("content", F.regexp_replace("line", f"{USER}|{ASSISTANT}", ""))
    return said.withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy("pos"))).select(key, "turn", "role", "content")


def last_messages(t: DataFrame, key: str, pairs: int = 10, keep_unpaired: bool = False) -> DataFrame:
    """The newest ``pairs`` pairs; with ``keep_unpaired`` one more message where their number is odd."""
    w = W.partitionBy(key)
    bound = F.lit(2 * pairs) + (F.pmod(F.count("*").over(w), F.lit(2)) if keep_unpaired else F.lit(0))
    return t.withColumn("back", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("bound", bound).filter("back <= bound").drop("back", "bound")


def budget_window(t: DataFrame, key: str, budget: int = 2800, most: int = 20, overhead: int = 20) -> DataFrame:
    """Adds back, cum and kept: newest first, the newest always, then while the running cost fits and fewer than ``most``."""
    w = W.partitionBy(key).orderBy(F.desc("turn"))
    cost = F.sum(F.length("content") + overhead).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")
    r = t.withColumn("back", F.row_number().over(w)).withColumn("cum", cost)
    return r.withColumn("kept", (F.col("back") == 1) | ((F.col("cum") <= budget) & (F.col("back") <= most)))
