"""Queries over text functions and per-document scalars."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.registry import query, sql_query
from foliant.session import read_table

WS = r"[\t-\r\x{85}\p{Z}]"


@query("word_count", rf"""SELECT doc_id, CAST(length(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) AS INT) AS chars,
  CAST(len(regexp_extract_all(text, '[^\t-\r\x{{85}}\p{{Z}}]+', 0)) AS INT) AS words FROM documents""")
def word_count(spark, d):
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", F.length(T.strip(t)).alias("chars"), T.word_count(t).alias("words"))


@query("non_blank_chars", rf"SELECT chunk_key, CAST(length(regexp_replace(content, '{WS}', '', 'g')) AS INT) AS n FROM chunks")
def non_blank_chars(spark, d):
    return read_table(spark, d, "chunks").select("chunk_key", T.non_blank_chars(F.col("content")).alias("n"))


@query("smart_join_lines", rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(l) = 0 THEN '' ELSE list_reduce(l, lambda a, b: a || CASE WHEN regexp_matches(a, '[A-Za-z0-9]$') AND regexp_matches(b, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || b) END AS joined FROM p""")
def smart_join_lines(spark, d):
    return read_table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.smart_join(F.split("text", "\n")).alias("joined"))


@query("html_escape", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS html FROM documents""")
def html_escape(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.html_escape(F.col("text")).alias("html"))


@query("preview", "SELECT chunk_key, left(content, 120) || CASE WHEN length(content) > 120 THEN '…' ELSE '' END AS preview FROM chunks")
def preview(spark, d):
    return read_table(spark, d, "chunks").select("chunk_key", T.preview(F.col("content")).alias("preview"))


sql_query(
    "doc_id_regex",
    r"SELECT leaflet_key, regexp_extract(file, r'[A-Z]{4}\d{7}(-\d+)?', 0) AS doc_id FROM leaflets",
    r"SELECT leaflet_key, regexp_extract(file, '[A-Z]{4}\d{7}(-\d+)?', 0) AS doc_id FROM leaflets",
)
sql_query(
    "meta_dates",
    r"SELECT leaflet_key, try_to_date(regexp_replace(regexp_replace(meta.`核准日期`, '[年月]', '-'), '日', ''), 'yyyy-MM-dd') AS approved FROM leaflets",
    r"SELECT leaflet_key, TRY_CAST(regexp_replace(regexp_replace(meta.核准日期, '[年月]', '-', 'g'), '日', '', 'g') AS DATE) AS approved FROM leaflets",
)
sql_query(
    "field_parse",
    "SELECT DISTINCT substring_index(substring_index(x, '：', -1), ':', -1) AS v FROM (SELECT explode(split(text, '\\n')) AS x FROM documents) WHERE x LIKE '用户%'",
    "SELECT DISTINCT string_split(string_split(x, '：')[-1], ':')[-1] AS v FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE x LIKE '用户%'",
)


@query("token_cost", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[一-鿿]', 0)) + greatest(1, round_even((length(text) - len(regexp_extract_all(text, '[一-鿿]', 0))) / 4.0, 0)) AS INT) AS cost FROM documents")
def token_cost(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.token_cost(F.col("text")).alias("cost"))


sql_query("content_hash", "SELECT doc_id, sha2(text, 256) AS h FROM documents", "SELECT doc_id, sha256(text) AS h FROM documents")
sql_query(
    "drop_last_line",
    r"SELECT chunk_key, regexp_replace(content, r'\n?[^\n]*\z', '') AS body FROM chunks WHERE type = 'figure' AND content IS NOT NULL",
    r"SELECT chunk_key, regexp_replace(content, '\n?[^\n]*$', '') AS body FROM chunks WHERE type = 'figure' AND content IS NOT NULL",
)


@query("page_label", "SELECT chunk_key, CASE WHEN page_start = page_end THEN 'p' || page_start ELSE 'p' || page_start || '-' || page_end END AS pages FROM chunks WHERE page_start IS NOT NULL AND page_end IS NOT NULL")
def page_label(spark, d):
    return read_table(spark, d, "chunks").filter("page_start IS NOT NULL AND page_end IS NOT NULL").select("chunk_key", T.page_range(F.col("page_start"), F.col("page_end")).alias("pages"))


sql_query(
    "char_entropy",
    """WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, explode(split(text, '')) AS ch FROM documents WHERE length(text) > 0) WHERE ch <> '' GROUP BY doc_id, ch),
    t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
    SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) + 0.0D AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id""",
    """WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).', 0)) AS ch FROM documents WHERE length(text) > 0) WHERE ch <> '' GROUP BY doc_id, ch),
    t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
    SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) + 0.0 AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id""",
)
sql_query("pop_variance", "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
sql_query("density", "SELECT l_linestatus, round(avg(CASE WHEN l_discount > 0 THEN 1.0D ELSE 0.0D END), 6) AS density FROM lineitem GROUP BY l_linestatus",
          "SELECT l_linestatus, round(avg(CASE WHEN l_discount > 0 THEN 1.0 ELSE 0.0 END), 6) AS density FROM lineitem GROUP BY l_linestatus")
sql_query("ratio_rounding", "SELECT pdf_hash, page, round(image_area_ratio, 4) AS r FROM page_features")
sql_query("chunk_type_counts", "SELECT type, count(*) AS n FROM chunks GROUP BY type ORDER BY type")
sql_query(
    "chunk_stats",
    "SELECT leaflet_key, CAST(floor(sum(length(content)) / count(*)) AS BIGINT) AS avg_len, CAST(min(length(content)) AS INT) AS min_len, CAST(max(length(content)) AS INT) AS max_len FROM chunks WHERE type = 'text' AND content IS NOT NULL GROUP BY leaflet_key",
)
sql_query("pages_max", "SELECT pdf_hash, CAST(coalesce(max(page) + 1, 0) AS INT) AS pages FROM page_features GROUP BY pdf_hash")
sql_query("section_by_title", "SELECT leaflet_key, section, min(chunk_key) AS first_chunk, min(page_start) AS page_start, coalesce(max(page_end), min(page_start)) AS page_end, count(*) AS n_items FROM chunks WHERE section IS NOT NULL GROUP BY leaflet_key, section")
sql_query("distinct_sets", "SELECT DISTINCT user_id, event_type FROM events")
sql_query("chunk_text",
          r"SELECT leaflet_key, array_join(transform(array_sort(collect_list(struct(id, content))), x -> x.content), '\n') AS body FROM chunks WHERE content IS NOT NULL GROUP BY leaflet_key",
          "SELECT leaflet_key, string_agg(content, chr(10) ORDER BY id, content) AS body FROM chunks WHERE content IS NOT NULL GROUP BY leaflet_key")
