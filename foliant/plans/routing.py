"""Queries over page, document and image routing."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import routing as R
from foliant.registry import query
from foliant.session import read_table

_PAGES = "p AS (SELECT DISTINCT pdf_hash, page, text_chars, image_count, image_area_ratio FROM page_features)"
_KIND = "CASE WHEN text_chars >= 100 THEN 'text' WHEN text_chars >= 10 THEN 'hybrid' WHEN coalesce(image_area_ratio, 0) >= 0.5 THEN 'scanned' ELSE 'blank' END"
_DOC = f"""{_PAGES}, k AS (SELECT *, {_KIND} AS kind FROM p), g AS (SELECT pdf_hash, count(*) AS n_pages, count(*) FILTER (WHERE kind = 'text') AS n_text, count(*) FILTER (WHERE kind = 'hybrid') AS n_hybrid,
 count(*) FILTER (WHERE kind = 'scanned') AS n_scanned, count(*) FILTER (WHERE kind = 'blank') AS n_blank FROM k GROUP BY pdf_hash),
 r AS (SELECT *, CASE WHEN n_pages = n_blank THEN 1.0 ELSE round(n_text / (n_pages - n_blank)::DOUBLE, 4) END AS text_ratio, CASE WHEN n_pages = n_blank THEN 0.0 ELSE round(n_scanned / (n_pages - n_blank)::DOUBLE, 4) END AS scanned_ratio FROM g),
 d AS (SELECT *, CASE WHEN n_pages = n_blank THEN 'text' WHEN scanned_ratio >= 0.5 THEN 'scanned' WHEN text_ratio >= 0.9 THEN 'text' ELSE 'hybrid' END AS doc_kind,
  CASE WHEN n_pages = n_blank THEN 'no effective page' ELSE n_text || ' text, ' || n_scanned || ' scanned of ' || (n_pages - n_blank) END AS reason FROM r)"""


def _pages(spark, d):
    return read_table(spark, d, "page_features").distinct()


@query("page_precheck", f"WITH {_PAGES} SELECT pdf_hash, page, text_chars, image_area_ratio, {_KIND} AS kind FROM p")
def page_precheck(spark, d):
    return _pages(spark, d).select("pdf_hash", "page", "text_chars", "image_area_ratio", R.page_kind(F.col("text_chars"), F.col("image_area_ratio")).alias("kind"))


@query("doc_precheck", f"WITH {_DOC} SELECT * FROM d")
def doc_precheck(spark, d):
    return R.document_kind(_pages(spark, d), "pdf_hash")


@query("engine_route", f"WITH {_DOC} SELECT pdf_hash, doc_kind, CASE doc_kind WHEN 'text' THEN 'pymupdf' ELSE 'mineru' END AS engine FROM d")
def engine_route(spark, d):
    return R.document_kind(_pages(spark, d), "pdf_hash").select("pdf_hash", "doc_kind", R.engine_of(F.col("doc_kind")).alias("engine"))


_FORCE = "(VALUES ('a', 'text'), ('b', 'pymupdf'), ('c', 'mineru'), ('d', 'hybrid'), ('e', 'scanned'), ('f', 'wrong')) AS f(id, wanted)"


@query("forced_route", f"SELECT id, CASE WHEN wanted IN ('text', 'pymupdf') THEN 'text' WHEN wanted = 'hybrid' THEN 'hybrid' WHEN wanted IN ('scanned', 'mineru') THEN 'scanned' END AS kind, CASE WHEN wanted NOT IN ('text', 'pymupdf', 'hybrid', 'scanned', 'mineru') THEN 'unknown engine: ' || wanted END AS error FROM {_FORCE}")
def forced_route(spark, d):
    m = F.create_map(*[F.lit(x) for kv in R.FORCED.items() for x in kv])
    kind = F.try_element_at(m, F.col("wanted"))
    return spark.sql(f"SELECT * FROM {_FORCE}").select("id", kind.alias("kind"), F.when(kind.isNull(), F.concat(F.lit("unknown engine: "), F.col("wanted"))).alias("error"))


_IMG = """(VALUES ('base', 0.2D, 5.0D, 0.05D, 300D, 100, 0, 0.0D), ('good', 0.2D, 5.0D, 0.05D, 300D, 100, 80, 0.95D), ('medium', 0.2D, 5.0D, 0.05D, 300D, 100, 30, 0.70D), ('complex', 0.05D, 7.0D, 0.2D, 900D, 100, 0, 0.0D),
 ('router', 0.05D, 7.0D, 0.05D, 900D, 100, 0, 0.0D), ('texty', 0.6D, 4.0D, 0.05D, 50D, 100, 0, 0.0D), ('photo', 0.2191D, 7.8441D, 0.0683D, 7318.02D, 29762, 0, 0.0D), ('screen', 0.3359D, 3.9324D, 0.0370D, 13978.23D, 1276, 341, 0.98997D))
 AS i(id, text_ratio, image_entropy, edge_density, color_variance, num_connected_components, probe_chars, probe_conf)"""
_SCORE = "+".join(f"CASE WHEN {c} {op} {b} THEN {p} ELSE 0 END" for c, op, b, p, _ in R.RULES)
_WHY = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} {op} {b} THEN '{n}{p:+d}' END" for c, op, b, p, n in R.RULES) + "], lambda x: x IS NOT NULL), '|')"
_DUCK_IMG = __import__("re").sub(r"(?<=\d)D\b", "::DOUBLE", _IMG)


@query("rule_score", f"SELECT id, {_SCORE} AS score, {_WHY} AS reasons FROM {_DUCK_IMG}")
def rule_score(spark, d):
    return spark.sql(f"SELECT * FROM {_IMG}").select("id", R.rule_score().alias("score"), R.rule_reasons().alias("reasons"))


@query("route_decision", f"""SELECT id, CASE WHEN s >= 3 THEN 'vlm' WHEN s <= -1 THEN 'ocr' WHEN probe_chars = 0 THEN 'vlm' WHEN probe_chars > 50 AND probe_conf > 0.85 THEN 'ocr' WHEN probe_chars < 10 THEN 'vlm' ELSE 'hybrid' END AS decision
 FROM (SELECT *, {_SCORE} AS s FROM {_DUCK_IMG})""")
def route_decision(spark, d):
    return spark.sql(f"SELECT * FROM {_IMG}").select("id", R.decision(R.rule_score(), F.col("probe_chars"), F.col("probe_conf")).alias("decision"))


_FEAT = """ch AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).', 0)) AS ch FROM documents WHERE length(text) > 0) GROUP BY doc_id, ch),
 tot AS (SELECT doc_id, sum(n) AS total, sum(n * unicode(ch)::DOUBLE) / sum(n) AS mean FROM ch GROUP BY doc_id),
 sp AS (SELECT doc_id, -sum(n / total * log2(n / total)) AS image_entropy, sum(n / total * (unicode(ch) - mean) ** 2) AS color_variance FROM ch JOIN tot USING (doc_id) GROUP BY doc_id),
 f AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text)::DOUBLE AS text_ratio, image_entropy, length(regexp_replace(text, '[^.,;:]', '', 'g')) / length(text)::DOUBLE AS edge_density,
  color_variance, len(string_split(text, chr(10))) * 10 AS num_connected_components FROM documents JOIN sp USING (doc_id))"""


@query("document_rule_score", f"WITH {_FEAT} SELECT doc_id, {_SCORE} AS score FROM f")
def document_rule_score(spark, d):
    """The image rules on features of the documents' texts."""
    f = read_table(spark, d, "documents").filter("length(text) > 0").withColumn("spread", R.character_spread(F.col("text"))).selectExpr(
        "doc_id", "length(regexp_replace(text, '[^A-Za-z]', '')) / double(length(text)) AS text_ratio", "spread.entropy AS image_entropy",
        "length(regexp_replace(text, '[^.,;:]', '')) / double(length(text)) AS edge_density", "spread.variance AS color_variance", "size(split(text, '\\n')) * 10 AS num_connected_components")
    return f.select("doc_id", R.rule_score().alias("score"))
