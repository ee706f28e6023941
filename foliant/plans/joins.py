"""Joins and join-like queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import geometry as G
from foliant.registry import query, spark_sql, sql_query
from foliant.session import read_table

_IN = "(VALUES (0, 'a.png'), (1, 'bad.png'), (2, 'c.png'), (3, 'd.png')) AS i(idx, path)"
_OUT = "(VALUES ('0', true, 'A', NULL), ('1', false, NULL, 'cannot read image'), ('x', true, 'Z', NULL), ('2', true, 'C', NULL)) AS o(ridx, ok, data, error)"
sql_query("batch_left_join", f"SELECT i.idx, i.path, coalesce(o.ok, false) AS ok, o.data, CASE WHEN o.ok IS NULL THEN '批量响应缺少该索引' ELSE o.error END AS error FROM {_IN} LEFT JOIN {_OUT} ON try_cast(o.ridx AS INT) = i.idx")
sql_query("zip_join",
          "SELECT c.chunk_key, c.n AS pos, c.total = p.total AS equal_length FROM (SELECT chunk_key, leaflet_key, row_number() OVER (PARTITION BY leaflet_key ORDER BY chunk_key) AS n, count(*) OVER (PARTITION BY leaflet_key) AS total FROM chunks) c JOIN (SELECT leaflet_key, image_id, row_number() OVER (PARTITION BY leaflet_key ORDER BY image_id) AS n, count(*) OVER (PARTITION BY leaflet_key) AS total FROM to_description) p ON p.leaflet_key = c.leaflet_key AND p.n = c.n")
sql_query("batch_groups", "SELECT leaflet_key, chunk_key, CAST(floor((row_number() OVER (PARTITION BY leaflet_key ORDER BY chunk_key) - 1) / 16) AS INT) AS grp FROM chunks")
sql_query("batch_counts", "SELECT engine, count(CASE WHEN ok THEN 1 END) AS n_ok, count(CASE WHEN NOT coalesce(ok, false) THEN 1 END) AS n_failed FROM to_description GROUP BY engine")

_BL = "(VALUES (1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 20.0, 10.0, 30.0), (1, 3, 5.0, 5.0, 5.0, 5.0), (2, 4, 0.0, 0.0, 10.0, 10.0), (1, 5, 4.0, 0.0, 14.0, 10.0)) AS b(page, seq, x0, y0, x1, y1)"
_TB = "(VALUES (1, 0.0, 0.0, 9.0, 9.0), (1, 100.0, 0.0, 110.0, 9.0)) AS t(page, x0, y0, x1, y1)"
_OV = "CASE WHEN (b.x1 - b.x0) * (b.y1 - b.y0) > 0 THEN greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) ELSE 0 END"


@query("bbox_overlap_antijoin", f"SELECT page, seq FROM {_BL} WHERE NOT EXISTS (SELECT 1 FROM {_TB} WHERE t.page = b.page AND {_OV} > 0.5)")
def bbox_overlap_antijoin(spark, d):
    box = lambda t: spark.sql(f"SELECT *, named_struct('x0', double(x0), 'y0', double(y0), 'x1', double(x1), 'y1', double(y1)) AS box FROM {t}")
    return G.outside_tables(box(_BL), box(_TB), ["page"]).select("page", "seq")


sql_query("bbox_union", f"SELECT page, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1 FROM {_BL} GROUP BY page")
sql_query("reading_order", f"SELECT seq, CAST(row_number() OVER (ORDER BY page, y0, x0, seq) AS INT) AS pos FROM {_BL}")
_FR = "(VALUES ('a', 1, 1, 3, 5), ('a', 2, 2, 3, 4), ('a', 3, 3, 2, 1), ('a', 5, 3, 2, 7), ('b', 1, 1, 4, 2), ('b', 2, 4, 4, 2)) AS t(doc_id, seq, page, cols, n_rows)"


@query("table_merge_islands", f"""WITH s AS (SELECT *, CASE WHEN lag(cols) OVER w IS NULL OR cols <> lag(cols) OVER w OR page - lag(page) OVER w > 1 OR seq - lag(seq) OVER w > 1 THEN 1 ELSE 0 END AS st FROM {_FR} WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
 g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id ORDER BY seq) AS INT) AS table_no FROM s) SELECT doc_id, table_no, min(page) AS page, max(page) AS page_end, max(cols) AS cols, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS merged FROM g GROUP BY doc_id, table_no""")
def table_merge_islands(spark, d):
    return G.merge_islands(spark.sql(f"SELECT * FROM {_FR}"), "doc_id")


# Captions stand above their table or figure, those of every third chunk below it.
ELEMENTS = """SELECT leaflet_key AS doc_id, page_start * 1000000000000 + chunk_key * 2 + CASE WHEN chunk_key % 3 = 0 THEN 1 ELSE 0 END AS seq, 'caption' AS kind, caption AS text, page_start AS page, CAST(chunk_key % 5 AS DOUBLE) AS y0
  FROM chunks WHERE caption IS NOT NULL
 UNION ALL SELECT leaflet_key, page_start * 1000000000000 + chunk_key * 2 + CASE WHEN chunk_key % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN type IN ('table', 'figure') THEN type ELSE 'paragraph' END, id, page_start, CAST(chunk_key % 5 AS DOUBLE) FROM chunks"""


@query("caption_attach", f"""WITH RECURSIVE e0 AS ({ELEMENTS}), e1 AS (SELECT * FROM e0 UNION ALL SELECT doc_id, max(seq) + 1, 'end', '', 0, 0.0 FROM e0 GROUP BY doc_id),
 e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn, regexp_matches(text, '^图\\s*\\d+') AS fig FROM e1),
 r AS (SELECT doc_id, 0::BIGINT AS rn, '' AS kind, '' AS text, 0 AS page, NULL::VARCAR AS w_text, 0 AS w_page, 0.0::DOUBLE AS w_y, false AS w_fig, false AS w_used, '' AS l_kind, false AS l_cap, NULL::VARCAR AS lost, 0 AS lost_page, NULL::VARCAR AS own, false AS back FROM e WHERE rn = 1
  UNION ALL SELECT doc_id, rn, kind, text, page, CASE WHEN kind = 'caption' AND NOT back THEN text WHEN shut THEN NULL ELSE w_text END, CASE WHEN kind = 'caption' THEN page ELSE w_page END, CASE WHEN kind = 'caption' THEN y0 ELSE w_y END, CASE WHEN kind = 'caption' THEN fig ELSE w_fig END,
   CASE WHEN kind = 'caption' THEN false ELSE w_used OR own IS NOT NULL END, CASE WHEN kind NOT IN ('caption', 'end') THEN kind WHEN lost THEN 'paragraph' ELSE l_kind END, CASE WHEN kind NOT IN ('caption', 'end') THEN own IS NOT NULL WHEN lost THEN false ELSE l_cap OR back END,
   CASE WHEN lost THEN w_text END, w_page, own, back
  FROM (SELECT *, kind = 'caption' AND fig AND NOT lost AND l_kind = 'figure' AND NOT l_cap AS back FROM (
   SELECT e.*, r.w_text, r.w_page, r.w_y, r.w_fig, r.w_used, r.l_kind, r.l_cap, e.kind IN ('caption', 'end') OR (r.w_text IS NOT NULL AND (NOT r.w_fig OR e.kind = 'table')) AS shut,
    CASE WHEN NOT r.w_fig AND e.kind IN ('table', 'figure') THEN r.w_text WHEN r.w_fig AND e.kind = 'figure' AND ((e.page = r.w_page AND e.y0 >= r.w_y - 1) OR e.page = r.w_page + 1) THEN r.w_text END AS own,
    r.w_text IS NOT NULL AND NOT r.w_used AND (e.kind IN ('caption', 'end') OR (NOT r.w_fig AND e.kind NOT IN ('table', 'figure')) OR (r.w_fig AND e.kind = 'table')) AS lost
   FROM r JOIN e ON e.doc_id = r.doc_id AND e.rn = r.rn + 1))),
 o AS (SELECT doc_id, rn, 0 AS part, 'paragraph' AS kind, lost AS text, lost_page AS page, NULL::VARCAR AS caption FROM r WHERE lost IS NOT NULL
  UNION ALL SELECT doc_id, rn, 1, kind, text, page, coalesce(own, CASE WHEN nback THEN ntext END) FROM (SELECT *, lead(back) OVER (PARTITION BY doc_id ORDER BY rn) AS nback, lead(text) OVER (PARTITION BY doc_id ORDER BY rn) AS ntext FROM r) WHERE kind NOT IN ('', 'caption', 'end'))
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rn, part) - 1 AS INT) AS pos, kind, text, page, caption FROM o""".replace("VARCAR", "VARCHAR"))
def caption_attach(spark, d):
    return G.attach_captions(spark_sql(spark, d, ELEMENTS), "doc_id")


_CACHE = "(SELECT DISTINCT sha2(text, 256) AS h, 'v1' AS version FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL UNION ALL SELECT DISTINCT sha2(text, 256), 'v0' FROM documents WHERE doc_id % 3 = 1 AND text IS NOT NULL)"
sql_query("cache_split", f"SELECT d.doc_id, c.h IS NOT NULL AS hit FROM documents d LEFT JOIN {_CACHE} c ON c.h = sha2(d.text, 256) AND c.version = 'v1'",
          f"SELECT d.doc_id, c.h IS NOT NULL AS hit FROM documents d LEFT JOIN {_CACHE} c ON c.h = sha256(d.text) AND c.version = 'v1'".replace("sha2(text, 256)", "sha256(text)"))
sql_query("cache_ttl_lru", """WITH e AS (SELECT user_id, max(ts) AS last_access, max(CASE WHEN value < 5 THEN TIMESTAMP '9999-01-01' ELSE ts + INTERVAL 7 DAY END) AS expire_at, max_by(event_id, ts) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id)
 SELECT user_id, last_access FROM e WHERE expire_at >= TIMESTAMP '2024-01-20' ORDER BY last_access DESC, user_id LIMIT 10000""")
sql_query("result_key", "SELECT leaflet_key, concat(pdf_hash, ':', left(sha2(concat_ws('|', route, '600', file), 256), 32)) AS ident FROM leaflets",
          "SELECT leaflet_key, pdf_hash || ':' || left(sha256(concat_ws('|', route, '600', file)), 32) AS ident FROM leaflets")


@query("newest_parse", "SELECT doc_id, leaflet_key AS newest FROM (SELECT meta.doc_id AS doc_id, leaflet_key, row_number() OVER (PARTITION BY meta.doc_id ORDER BY parsed_at DESC, leaflet_key DESC) AS n FROM leaflets WHERE parsed_at IS NOT NULL) WHERE n = 1")
def newest_parse(spark, d):
    """The newest parse of every document; of those at the same second the one with the largest key."""
    x = read_table(spark, d, "leaflets").filter("parsed_at IS NOT NULL")
    return x.groupBy(F.col("meta.doc_id").alias("doc_id")).agg(F.max_by("leaflet_key", F.struct("parsed_at", "leaflet_key")).alias("newest"))


sql_query("newest_output", "SELECT stem, path FROM (SELECT stem, path, row_number() OVER (PARTITION BY stem ORDER BY CASE WHEN contains(path, stem) THEN 1 ELSE 0 END DESC, mtime DESC, path) AS rn FROM (VALUES ('a', 'out/a_content_list.json', 5), ('a', 'out/x_content_list.json', 9), ('a', 'old/a_content_list.json', 3), ('b', 'q/z_content_list.json', 1)) AS t(stem, path, mtime)) AS r WHERE rn = 1")
_ML = "(VALUES ('d', 1, 'text', 1, 'Head', NULL, 0), ('d', 2, 'text', 0, 'para', NULL, 0), ('d', 3, 'table', 0, '<table><tr><td>1</td></tr><tr></tr></table>', 'Tab 1', 1), ('d', 4, 'image', 0, 'img/1.png', NULL, 1), ('d', 5, 'equation', 0, 'x', NULL, 2), ('d', 6, 'text', 1, 'Head', NULL, 2)) AS m(doc, seq, type, level, body, caption, page_idx)"
sql_query("mineru_items",
          f"SELECT doc, seq, CASE type WHEN 'text' THEN CASE WHEN level > 0 THEN 'heading' ELSE 'paragraph' END WHEN 'table' THEN 'table' WHEN 'image' THEN 'figure' END AS kind, body, nullif(coalesce(caption, ''), '') AS caption, CASE WHEN type = 'table' THEN CAST((length(body) - length(replace(body, '<tr>', ''))) / 4 AS INT) END AS n_rows FROM {_ML} WHERE type IN ('text', 'table', 'image')")
sql_query("mineru_images", f"SELECT seq, CASE WHEN body = 'img/1.png' THEN replace(body, 'img/', 'figures/') ELSE body END AS path FROM {_ML} WHERE type = 'image'")
sql_query("mineru_sections", f"SELECT section, min(seq) AS first_seq, count(*) AS n_items, max(page_idx) + 1 AS page_end FROM (SELECT seq, page_idx, coalesce(last_value(CASE WHEN type = 'text' AND level > 0 THEN body END) IGNORE NULLS OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING), '文档头') AS section FROM {_ML} WHERE type <> 'equation') AS x GROUP BY section",
          f"SELECT section, min(seq) AS first_seq, count(*) AS n_items, max(page_idx) + 1 AS page_end FROM (SELECT seq, page_idx, coalesce(last_value(CASE WHEN type = 'text' AND level > 0 THEN body END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING), '文档头') AS section FROM {_ML} WHERE type <> 'equation') AS x GROUP BY section")


@query("mineru_pack", """WITH RECURSIVE p AS (SELECT leaflet_key, chunk_key, length(coalesce(content, '')) AS n, coalesce(type <> 'text', true) AS s, row_number() OVER (PARTITION BY leaflet_key ORDER BY chunk_key) AS rn FROM chunks),
 r AS (SELECT leaflet_key, chunk_key, rn, n AS len, 0 AS chunk_no FROM p WHERE rn = 1
 UNION ALL SELECT p.leaflet_key, p.chunk_key, p.rn, CASE WHEN (r.len + p.n > 2000 OR p.s) AND r.len > 0 THEN p.n ELSE r.len + p.n END, CASE WHEN (r.len + p.n > 2000 OR p.s) AND r.len > 0 THEN r.chunk_no + 1 ELSE r.chunk_no END FROM r JOIN p ON p.leaflet_key = r.leaflet_key AND p.rn = r.rn + 1)
 SELECT leaflet_key, chunk_key, chunk_no FROM r""")
def mineru_pack(spark, d):
    """Chunks of a leaflet packed again into larger ones; tables and figures start a chunk."""
    from foliant.operators.layout import pack

    x = read_table(spark, d, "chunks").select("leaflet_key", F.col("chunk_key").alias("seq"), F.coalesce("content", F.lit("")).alias("text"), F.coalesce(F.col("type") != "text", F.lit(True)).alias("s"))
    return pack(x, ["leaflet_key"], limit=2000, start="s").select("leaflet_key", F.col("seq").alias("chunk_key"), "chunk_no")


sql_query("union_all", "SELECT chunk_key AS id, 'chunk' AS src FROM chunks UNION ALL SELECT image_id, 'page' FROM to_description UNION ALL SELECT vec_id, 'vector' FROM embed_response")
sql_query("page_elements", "SELECT leaflet_key, page_start AS page, count(*) AS n, min(chunk_key) AS first_chunk FROM chunks GROUP BY leaflet_key, page_start")

# Tables of the chunks, divided into fragments of four rows that repeat the header on the next page; a few begin one page too late, a few repeat the header only.
_CELLS = "list_transform(list_filter(string_split(content, chr(10)), lambda l: starts_with(l, '|') AND NOT starts_with(l, '| ---')), lambda l: string_split(l[3:-3], ' | '))"


@query("table_fragments", f"""WITH RECURSIVE t AS (SELECT leaflet_key, chunk_key, page_start, caption, {_CELLS} AS r FROM chunks WHERE type = 'table'),
 f AS (SELECT *, unnest(range(greatest(1, (len(r) + 2) // 4))) AS i FROM t),
 e0 AS (SELECT leaflet_key AS doc_id, page_start * 1000000000000 + chunk_key * 100 AS seq, 'caption' AS kind, page_start AS page, []::VARCHAR[][] AS rows FROM t WHERE caption IS NOT NULL
  UNION ALL SELECT leaflet_key, page_start * 1000000000000 + chunk_key * 100 + 1 + i, 'table', page_start + i + CASE WHEN chunk_key % 7 = 0 AND i > 0 THEN 1 ELSE 0 END, CASE WHEN chunk_key % 5 = 0 AND i = 1 THEN r[1:1] ELSE list_concat(r[1:1], r[4 * i + 2:4 * i + 5]) END FROM f),
 e AS (SELECT doc_id, kind, page, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn, coalesce(list_max(list_transform(rows, lambda x: len(x))), 0) AS cols, list_transform(rows, lambda x: array_to_string(list_transform(x, lambda c: trim(replace(coalesce(c, ''), chr(10), ''))), '|')) AS norms FROM e0),
 g AS (SELECT doc_id, rn, 0 AS grp, kind, page, page AS page_end, norms, cols, 1 AS merged, '' AS above FROM e WHERE rn = 1
  UNION ALL SELECT doc_id, rn, CASE WHEN goes THEN grp ELSE grp + 1 END, CASE WHEN goes THEN k0 ELSE kind END, CASE WHEN goes THEN p0 ELSE page END, page, CASE WHEN goes THEN list_concat(n0, tail) ELSE norms END,
    CASE WHEN NOT goes THEN cols WHEN len(tail) > 0 THEN greatest(c0, cols) ELSE c0 END, CASE WHEN NOT goes THEN 1 WHEN len(tail) > 0 THEN m0 + 1 ELSE m0 END, CASE WHEN goes THEN above ELSE k0 END
  FROM (SELECT e.*, g.grp, g.kind AS k0, g.page AS p0, g.norms AS n0, g.cols AS c0, g.merged AS m0, g.above, e.kind = 'table' AND g.kind = 'table' AND e.page - g.page_end <= 1 AND (e.cols = g.cols OR (g.above = 'caption' AND len(g.norms) <= 3 AND e.page - g.page_end = 1)) AS goes,
     CASE WHEN coalesce(list_position(list_transform(e.norms, lambda x: list_contains(g.norms[1:3], x)), false), 0) = 0 THEN []::VARCHAR[] ELSE e.norms[list_position(list_transform(e.norms, lambda x: list_contains(g.norms[1:3], x)), false):] END AS tail
   FROM g JOIN e ON e.doc_id = g.doc_id AND e.rn = g.rn + 1))
 SELECT doc_id, grp AS pos, kind, page, page_end, CAST(len(norms) AS INT) AS n_rows, merged FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY rn DESC) AS back FROM g) WHERE back = 1""")
def table_fragments(spark, d):
    from foliant.operators.fragments import merge_tables

    t = read_table(spark, d, "chunks").filter("type = 'table'").selectExpr(
        "leaflet_key", "chunk_key", "page_start", "caption", r"transform(filter(split(content, '\n'), l -> startswith(l, '|') AND NOT startswith(l, '| ---')), l -> split(substr(l, 3, length(l) - 4), ' [|] ')) AS r")
    seq = "page_start * 1000000000000 + chunk_key * 100"
    captions = t.filter("caption IS NOT NULL").selectExpr("leaflet_key AS doc_id", f"{seq} AS seq", "'caption' AS kind", "page_start AS page", "cast(array() AS array<array<string>>) AS rows")
    parts = t.withColumn("i", F.explode(F.expr("sequence(0, greatest(1, div(size(r) + 2, 4)) - 1)".replace("div(size(r) + 2, 4)", "int(floor((size(r) + 2) / 4))")))).selectExpr(
        "leaflet_key AS doc_id", f"{seq} + 1 + i AS seq", "'table' AS kind", "page_start + i + CASE WHEN chunk_key % 7 = 0 AND i > 0 THEN 1 ELSE 0 END AS page",
        "CASE WHEN chunk_key % 5 = 0 AND i = 1 THEN slice(r, 1, 1) ELSE concat(slice(r, 1, 1), slice(r, 4 * i + 2, 4)) END AS rows")
    return merge_tables(captions.unionByName(parts).withColumn("page_end", F.col("page")), "doc_id")


sql_query("bold_lines", "SELECT id, exists(spans, s -> s.flags & 16 <> 0 OR contains(s.font, 'Bold')) AS bold FROM (VALUES (1, array(named_struct('flags', 16, 'font', 'A'))), (2, array(named_struct('flags', 4, 'font', 'A'), named_struct('flags', 0, 'font', 'X-Bold'))), (3, array(named_struct('flags', 4, 'font', 'A')))) AS t(id, spans)",
          "SELECT id, len(list_filter(spans, lambda s: s.flags & 16 <> 0 OR contains(s.font, 'Bold'))) > 0 AS bold FROM (VALUES (1, [{'flags': 16, 'font': 'A'}]), (2, [{'flags': 4, 'font': 'A'}, {'flags': 0, 'font': 'X-Bold'}]), (3, [{'flags': 4, 'font': 'A'}])) AS t(id, spans)")
sql_query("clean_description", "SELECT image_id, nullif(trim(ocr_text), '') AS ocr_text, nullif(trim(vlm_description), '') AS vlm_description FROM to_description")
