"""Queries over conversation memory; the conversations are the chat texts of ``documents``."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import memory as M
from foliant.registry import query
from foliant.session import read_table

_T = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE doc_type = 'chat' AND text IS NOT NULL),
 t AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS turn, CASE WHEN regexp_matches(line, '{M.USER}') THEN 'user' ELSE 'assistant' END AS role, regexp_replace(line, '{M.USER}|{M.ASSISTANT}', '') AS content
 FROM l WHERE regexp_matches(line, '{M.USER}|{M.ASSISTANT}'))"""
_B = f"""{_T}, b AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) AS INT) AS back, CAST(sum(length(content) + 20) OVER (PARTITION BY doc_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM t),
 w AS (SELECT *, back = 1 OR (cum <= 2800 AND back <= 20) AS kept FROM b)"""


def _turns(spark, d):
    return M.turns(read_table(spark, d, "documents").filter("doc_type = 'chat'"))


@query("chat_turns", f"WITH {_T} SELECT * FROM t")
def chat_turns(spark, d):
    return _turns(spark, d)


@query("history_last_n", f"WITH {_T} SELECT doc_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) AS b FROM t) WHERE b <= 20")
def history_last_n(spark, d):
    return M.last_messages(_turns(spark, d), "doc_id")


@query("history_pairs_parity", f"WITH {_T} SELECT doc_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY doc_id) AS n FROM t) WHERE b <= 6 + n % 2")
def history_pairs_parity(spark, d):
    return M.last_messages(_turns(spark, d), "doc_id", pairs=3, keep_unpaired=True)


@query("history_budget", f"WITH {_B} SELECT doc_id, turn, back, cum FROM w WHERE kept")
def history_budget(spark, d):
    return M.budget_window(_turns(spark, d), "doc_id").filter("kept").select("doc_id", "turn", "back", "cum")


@query("history_overflow", f"WITH {_B} SELECT doc_id, max(turn) AS summary_until, count(*) AS n, left(string_agg(content, ' ' ORDER BY turn), 1200) || CASE WHEN length(string_agg(content, ' ' ORDER BY turn)) > 1200 THEN '…' ELSE '' END AS summary FROM w WHERE NOT kept GROUP BY doc_id")
def history_overflow(spark, d):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), " ")
    g = M.budget_window(_turns(spark, d), "doc_id").filter("NOT kept").groupBy("doc_id").agg(F.max("turn").alias("summary_until"), F.count("*").alias("n"), body.alias("s"))
    return g.select("doc_id", "summary_until", "n", F.concat(F.substring("s", 1, 1200), F.when(F.length("s") > 1200, "…").otherwise("")).alias("summary"))


@query("history_text", f"WITH {_T} SELECT doc_id, string_agg(CASE role WHEN 'user' THEN '用户: ' ELSE '助手: ' END || content, chr(10) ORDER BY turn) AS history FROM t GROUP BY doc_id")
def history_text(spark, d):
    line = F.concat(F.when(F.col("role") == "user", "用户: ").otherwise("助手: "), F.col("content"))
    return _turns(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda x: x["x"]), "\n").alias("history"))


@query("session_lessons", f"WITH {_T}, m AS (SELECT doc_id, max_by(content, turn) FILTER (WHERE role = 'assistant') AS lesson FROM t GROUP BY doc_id), r AS (SELECT *, row_number() OVER (ORDER BY doc_id DESC) AS b FROM m WHERE lesson IS NOT NULL) SELECT doc_id, lesson FROM r WHERE b <= 3")
def session_lessons(spark, d):
    """The last reflection of each task, of the newest three tasks that have one."""
    m = _turns(spark, d).filter("role = 'assistant'").groupBy("doc_id").agg(F.max_by("content", "turn").alias("lesson"))
    return m.orderBy(F.desc("doc_id")).limit(3)


@query("last_execution", f"WITH {_T} SELECT doc_id, max_by(content, turn) FILTER (WHERE role = 'user') AS last_user, max_by(content, turn) FILTER (WHERE role = 'assistant') AS last_assistant, count(*) AS n FROM t GROUP BY doc_id")
def last_execution(spark, d):
    return _turns(spark, d).groupBy("doc_id").agg(
        F.expr("max_by(content, turn) FILTER (WHERE role = 'user')").alias("last_user"), F.expr("max_by(content, turn) FILTER (WHERE role = 'assistant')").alias("last_assistant"), F.count("*").alias("n"))


@query("turn_cap", f"WITH {_T} SELECT doc_id, least(count(*), 10) AS used, CASE WHEN count(*) > 10 THEN 'turn limit reached' ELSE 'ok' END AS state FROM t GROUP BY doc_id")
def turn_cap(spark, d):
    return _turns(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.least("n", F.lit(10)).cast("long").alias("used"), F.when(F.col("n") > 10, "turn limit reached").otherwise("ok").alias("state"))


@query("step_context", f"WITH {_T} SELECT doc_id, turn, coalesce(string_agg('step_' || turn || ': ' || content, ' | ') OVER (PARTITION BY doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM t WHERE role = 'assistant'")
def step_context(spark, d):
    """Each step sees all results before it."""
    w = W.partitionBy("doc_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    x = F.concat(F.lit("step_"), F.col("turn"), F.lit(": "), F.col("content"))
    return _turns(spark, d).filter("role = 'assistant'").withColumn("c", F.collect_list(x).over(w)).select("doc_id", "turn", F.array_join("c", " | ").alias("context"))


@query("token_concat", "SELECT leaflet_key, count(*) AS n, string_agg(content, '' ORDER BY chunk_key) AS stream FROM chunks WHERE content IS NOT NULL AND content <> '' GROUP BY leaflet_key")
def token_concat(spark, d):
    """Parts of a stream in order; a stream is as long as its leaflet."""
    x = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_key", F.col("content").alias("c")))), lambda y: y["c"]), "")
    return read_table(spark, d, "chunks").filter("content IS NOT NULL AND content <> ''").groupBy("leaflet_key").agg(F.count("*").alias("n"), x.alias("stream"))
