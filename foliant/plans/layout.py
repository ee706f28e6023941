"""Queries over element streams and chunking; the element stream is the lines of ``documents``."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import layout as L
from foliant.registry import query, sql_query
from foliant.session import read_table

WS = r"[\t-\r\x{85}\p{Z}]"
EL = rf"""el AS (SELECT doc_id, seq, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS text FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS seq FROM documents WHERE text IS NOT NULL)
  WHERE regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') <> '')"""
KIND = r"""CASE WHEN regexp_matches(text, '^【[^】]{1,20}】$') THEN 'heading' WHEN regexp_matches(text, '^(表|图)\s*\d+\s*[:：]?\s*') THEN 'caption'
  WHEN NOT regexp_matches(text, '[。；！？]$') AND (length(text) <= 30 OR (length(text) <= 50 AND NOT regexp_matches(text, '^[*＊†‡注]') AND NOT contains(text, '='))) THEN 'subheading' ELSE 'paragraph' END"""
FILL = rf"""{EL}, k AS (SELECT *, {KIND} AS kind FROM el),
 s AS (SELECT *, CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS INT) AS section_id FROM k),
 f AS (SELECT doc_id, seq, text, kind, section_id,
   coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '文档头') AS section,
   last_value(CASE WHEN kind = 'subheading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, section_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS sub_section FROM s)"""


def _elements(spark, d):
    return L.elements(read_table(spark, d, "documents"))


@query("elements", f"WITH {EL} SELECT * FROM el")
def elements(spark, d):
    return _elements(spark, d)


@query("element_kind", f"WITH {EL} SELECT doc_id, seq, {KIND} AS kind FROM el")
def element_kind(spark, d):
    return _elements(spark, d).select("doc_id", "seq", L.element_kind(F.col("text")).alias("kind"))


@query("subheading_filter", f"WITH {EL} SELECT doc_id, seq, text FROM el WHERE {KIND} = 'subheading'")
def subheading_filter(spark, d):
    return _elements(spark, d).filter(L.element_kind(F.col("text")) == "subheading")


@query("section_fill", f"WITH {FILL} SELECT doc_id, seq, section_id, section, sub_section FROM f")
def section_fill(spark, d):
    return L.fill_sections(_elements(spark, d)).select("doc_id", "seq", "section_id", "section", "sub_section")


@query("section_summary", f"""WITH {FILL} SELECT doc_id, section_id, section, count(*) FILTER (WHERE kind <> 'heading') AS n_items, min(seq) AS first_seq, max(seq) AS last_seq
 FROM f GROUP BY doc_id, section_id, section HAVING count(*) FILTER (WHERE kind <> 'heading') > 0 OR section <> '文档头'""")
def section_summary(spark, d):
    return L.section_summary(L.fill_sections(_elements(spark, d)))


_PACK = """ p AS (SELECT doc_id, seq, text, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM el),
 r AS (SELECT doc_id, seq, text, rn, n AS len, 0 AS chunk_no FROM p WHERE rn = 1
  UNION ALL SELECT p.doc_id, p.seq, p.text, p.rn, CASE WHEN r.len + p.n > 600 AND r.len > 0 THEN p.n ELSE r.len + p.n END, CASE WHEN r.len + p.n > 600 AND r.len > 0 THEN r.chunk_no + 1 ELSE r.chunk_no END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.rn = r.rn + 1)"""
_CHUNKS = f"""WITH RECURSIVE {EL},{_PACK}, c AS (SELECT doc_id, chunk_no, string_agg(text, chr(10) ORDER BY seq) AS content, CAST(sum(length(text)) AS BIGINT) AS char_len, min(seq) AS seq FROM r GROUP BY doc_id, chunk_no)"""


@query("chunk_pack", f"WITH RECURSIVE {EL},{_PACK} SELECT doc_id, seq, chunk_no FROM r")
def chunk_pack(spark, d):
    return L.pack(_elements(spark, d), ["doc_id"]).select("doc_id", "seq", "chunk_no")


def packed_chunks(spark, d):
    return L.chunks(L.pack(_elements(spark, d), ["doc_id"]), ["doc_id"])


@query("chunk_ids", f"{_CHUNKS} SELECT doc_id, chunk_no, content, char_len, 'c' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS VARCHAR), 3, '0') AS id FROM c")
def chunk_ids(spark, d):
    return packed_chunks(spark, d).select("doc_id", "chunk_no", "content", "char_len", "id")


@query("chunk_pack_markdown", f"""WITH RECURSIVE {EL}, p AS (SELECT doc_id, seq, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM el),
 r AS (SELECT doc_id, seq, rn, CASE WHEN n > 600 THEN 0 ELSE n END AS len, CASE WHEN n > 600 THEN 1 ELSE 0 END AS nxt, 0 AS chunk_no FROM p WHERE rn = 1
  UNION ALL SELECT p.doc_id, p.seq, p.rn, CASE WHEN r.len + p.n > 600 THEN 0 ELSE r.len + p.n END, CASE WHEN r.len + p.n > 600 THEN r.nxt + 1 ELSE r.nxt END, r.nxt FROM r JOIN p ON p.doc_id = r.doc_id AND p.rn = r.rn + 1)
 SELECT doc_id, seq, chunk_no FROM r""")
def chunk_pack_markdown(spark, d):
    return L.pack(_elements(spark, d), ["doc_id"], over=True).select("doc_id", "seq", "chunk_no")


# The leaflets' chunks as element streams: text lines are blocks (bold where they are the sub-section's title), tables and figures stand whole.
_BLOCKS = rf"""b0 AS (SELECT leaflet_key, page_start, chunk_key, type, section, sub_section, unnest(CASE WHEN type = 'text' THEN string_split(content, chr(10)) ELSE [content] END) AS line,
   unnest(range(CASE WHEN type = 'text' THEN len(string_split(content, chr(10))) ELSE 1 END)) AS i FROM chunks WHERE content IS NOT NULL),
 b1 AS (SELECT *, CASE WHEN type = 'text' THEN regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') ELSE line END AS text FROM b0),
 b2 AS (SELECT leaflet_key, page_start AS page, coalesce(section, '文档头') AS section, text, CASE WHEN type <> 'text' THEN type WHEN coalesce(text = sub_section, false) AND regexp_matches(text, '^(表|图)\s*\d+\s*[:：]?\s*') THEN 'paragraph'
   WHEN coalesce(text = sub_section, false) AND NOT regexp_matches(text, '[。；！？]$') AND (length(text) <= 30 OR (length(text) <= 50 AND NOT regexp_matches(text, '^[*＊†‡注]') AND NOT contains(text, '='))) THEN 'subheading' ELSE 'paragraph' END AS kind,
   row_number() OVER (PARTITION BY leaflet_key ORDER BY page_start, chunk_key, i) AS rn FROM b1 WHERE text <> ''),
 b AS (SELECT *, CASE WHEN section IS DISTINCT FROM lag(section) OVER (PARTITION BY leaflet_key ORDER BY rn) THEN 1 ELSE 0 END AS new_section FROM b2)"""


@query("build_chunks", f"""WITH RECURSIVE {_BLOCKS}, r AS (SELECT leaflet_key, rn, kind, section, text, page, length(text) AS len, 1 AS no, CASE WHEN kind = 'subheading' THEN text END AS sub FROM b WHERE rn = 1
  UNION ALL SELECT b.leaflet_key, b.rn, b.kind, b.section, b.text, b.page, CASE WHEN cut THEN length(b.text) ELSE len + length(b.text) END, CASE WHEN cut THEN no + 1 ELSE no END, CASE WHEN b.kind = 'subheading' THEN b.text WHEN b.new_section = 1 THEN NULL ELSE sub END
  FROM (SELECT b.*, r.len, r.no, r.sub, b.new_section = 1 OR b.kind <> 'paragraph' OR r.kind IN ('table', 'figure') OR r.len + length(b.text) > 600 AS cut FROM r JOIN b ON b.leaflet_key = r.leaflet_key AND b.rn = r.rn + 1) AS b),
 g AS (SELECT leaflet_key, no, string_agg(text, chr(10) ORDER BY rn) AS content, min_by(kind, rn) AS k, min_by(section, rn) AS section, arg_min_null(sub, rn) AS sub_section, min(page) AS page_start, max_by(page, rn) AS page_end FROM r GROUP BY leaflet_key, no)
 SELECT leaflet_key, 'c' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS id, CASE WHEN k IN ('table', 'figure') THEN k ELSE 'text' END AS type, section, sub_section, content, page_start, page_end, length(content) AS char_len,
  CASE WHEN k IN ('table', 'figure') THEN k || '-' || lpad(CAST(row_number() OVER (PARTITION BY leaflet_key, k ORDER BY no) AS VARCHAR), 2, '0') END AS block_id FROM g""")
def build_chunks(spark, d):
    """Chunks built anew from the leaflets' element streams, with sections, sub-headings, tables and figures."""
    c = read_table(spark, d, "chunks").filter("content IS NOT NULL").select("leaflet_key", "page_start", "chunk_key", "type", F.coalesce("section", F.lit(L.PREAMBLE)).alias("section"), "sub_section", F.posexplode(
        F.when(F.col("type") == "text", F.split("content", "\n")).otherwise(F.array("content"))).alias("i", "line"))
    text = F.when(F.col("type") == "text", L.strip(F.col("line"))).otherwise(F.col("line"))
    w = W.partitionBy("leaflet_key").orderBy("page_start", "chunk_key", "i")
    kind = F.when(F.col("type") != "text", F.col("type")).otherwise(L.bold_kind(F.col("text"), F.col("text") == F.col("sub_section"), F.lit(1)))
    x = c.withColumn("text", text).filter("text <> ''").withColumn("kind", kind).withColumn("kind", F.when(F.col("kind") == "caption", "paragraph").otherwise(F.col("kind"))).withColumn("seq", F.row_number().over(w))
    o = W.partitionBy("leaflet_key").orderBy("seq")
    x = x.withColumn("section_no", F.sum((~F.col("section").eqNullSafe(F.lag("section").over(o))).cast("int")).over(o)).withColumnRenamed("page_start", "page")
    return L.build_chunks(x.select("leaflet_key", "seq", "section_no", "section", "kind", "text", "page"), "leaflet_key")


# Leaflets written as Markdown: each chunk's section as a heading, then its content.
_MD = "SELECT leaflet_key, {agg} AS md FROM chunks WHERE content IS NOT NULL GROUP BY leaflet_key"


@query("markdown_chunks", rf"""WITH RECURSIVE m AS ({_MD.format(agg="string_agg('## ' || coalesce(section, '') || chr(10) || content, chr(10) || chr(10) ORDER BY page_start, chunk_key)")}),
 l0 AS (SELECT leaflet_key, unnest(string_split_regex(md, '
||
')) AS text, unnest(range(len(string_split_regex(md, '
||
')))) AS seq FROM m),
 l AS (SELECT *, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS t, row_number() OVER (PARTITION BY leaflet_key ORDER BY seq) AS rn FROM l0),
 h AS (SELECT *, regexp_matches(t, '^#{{1,6}}\s+.*$') AS head FROM l),
 r AS (SELECT leaflet_key, rn, text, head, CASE WHEN head THEN regexp_replace(regexp_extract(t, '^(#{{1,6}})\s+(.*)$', 2), '^{WS}+|{WS}+$', '', 'g') ELSE '文档头' END AS section, CASE WHEN head THEN 0 ELSE length(text) END AS len, CASE WHEN head THEN 0 ELSE 1 END AS no FROM h WHERE rn = 1
  UNION ALL SELECT h.leaflet_key, h.rn, h.text, h.head, CASE WHEN h.head THEN regexp_replace(regexp_extract(h.t, '^(#{{1,6}})\s+(.*)$', 2), '^{WS}+|{WS}+$', '', 'g') ELSE r.section END,
   CASE WHEN h.head THEN 0 WHEN r.len > 600 THEN length(h.text) ELSE r.len + length(h.text) END, CASE WHEN h.head THEN r.no WHEN r.head OR r.len > 600 OR r.no = 0 THEN r.no + 1 ELSE r.no END FROM r JOIN h ON h.leaflet_key = r.leaflet_key AND h.rn = r.rn + 1),
 g AS (SELECT leaflet_key, no, min(section) AS section, regexp_replace(string_agg(text, chr(10) ORDER BY rn), '^{WS}+|{WS}+$', '', 'g') AS content FROM r WHERE NOT head GROUP BY leaflet_key, no)
 SELECT leaflet_key, 'c' || lpad(CAST(row_number() OVER (PARTITION BY leaflet_key ORDER BY no) AS VARCHAR), 3, '0') AS id, section, content, length(content) AS char_len FROM g WHERE content <> ''""")
def markdown_chunks(spark, d):
    md = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_start", "chunk_key", F.concat(F.lit("## "), F.coalesce("section", F.lit("")), F.lit("\n"), "content").alias("c")))), lambda x: x["c"]), "\n\n")
    return L.markdown_chunks(read_table(spark, d, "chunks").filter("content IS NOT NULL").groupBy("leaflet_key").agg(md.alias("md")), "leaflet_key", "md")


sql_query(
    "chunk_index_text",
    r"""SELECT chunk_key, CASE WHEN type = 'figure' AND startswith(element_at(split(content, '\n'), -1), 'figures/') THEN regexp_replace(content, r'\n?[^\n]*\z', '')
      WHEN type = 'text' THEN concat(coalesce(section, ''), CASE WHEN sub_section IS NULL OR sub_section = '' THEN '' ELSE concat(' / ', sub_section) END, '\n', content) ELSE content END AS index_text FROM chunks""",
    r"""SELECT chunk_key, CASE WHEN type = 'figure' AND starts_with(string_split(content, chr(10))[-1], 'figures/') THEN regexp_replace(content, '\n?[^\n]*$', '')
      WHEN type = 'text' THEN coalesce(section, '') || CASE WHEN sub_section IS NULL OR sub_section = '' THEN '' ELSE ' / ' || sub_section END || chr(10) || content ELSE content END AS index_text FROM chunks""",
)
sql_query("blank_rejects", r"SELECT chunk_key FROM chunks WHERE content IS NULL OR NOT content rlike r'(?U)\S'", rf"SELECT chunk_key FROM chunks WHERE content IS NULL OR NOT regexp_matches(content, '[^\t-\r\x{{85}}\p{{Z}}]')")
