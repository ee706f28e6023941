"""Queries over external models and their results."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import models as M
from foliant.registry import query, sql_query
from foliant.session import read_table

sql_query("normalize_response",
          """SELECT image_id, CASE WHEN startswith(engine, 'ocr') THEN nullif(trim(coalesce(ocr_text, '')), '') WHEN engine = 'hybrid' THEN nullif(trim(coalesce(ocr_text, '')), '') END AS ocr, CASE WHEN startswith(engine, 'ocr') THEN NULL ELSE nullif(trim(coalesce(vlm_description, '')), '') END AS vlm,
          coalesce(nullif(trim(coalesce(ocr_text, '')), ''), nullif(trim(coalesce(vlm_description, '')), ''), error) AS shown FROM to_description""",
          """SELECT image_id, CASE WHEN starts_with(engine, 'ocr') THEN nullif(trim(coalesce(ocr_text, '')), '') WHEN engine = 'hybrid' THEN nullif(trim(coalesce(ocr_text, '')), '') END AS ocr, CASE WHEN starts_with(engine, 'ocr') THEN NULL ELSE nullif(trim(coalesce(vlm_description, '')), '') END AS vlm,
          coalesce(nullif(trim(coalesce(ocr_text, '')), ''), nullif(trim(coalesce(vlm_description, '')), ''), error) AS shown FROM to_description""")
_D = "CASE image_id % 3 WHEN 0 THEN 'vlm' WHEN 1 THEN 'ocr' ELSE 'hybrid' END"


@query("fallback_merge", f"""WITH x AS (SELECT image_id, {_D} AS decision, coalesce(ocr_text, '') <> '' AS o, coalesce(vlm_description, '') <> '' AS v, ocr_text, vlm_description FROM to_description),
 e AS (SELECT *, coalesce(CASE decision WHEN 'vlm' THEN CASE WHEN v THEN 'vlm' WHEN o THEN 'ocr(fallback)' END WHEN 'ocr' THEN CASE WHEN o THEN 'ocr' END ELSE CASE WHEN o AND v THEN 'hybrid' WHEN v THEN 'vlm(fallback)' WHEN o THEN 'ocr(fallback)' END END, 'none') AS engine FROM x)
 SELECT image_id, engine, length(CASE WHEN engine = 'hybrid' THEN ocr_text || chr(10) || vlm_description WHEN starts_with(engine, 'vlm') THEN vlm_description WHEN engine <> 'none' THEN ocr_text END)::INT AS n FROM e""")
def fallback_merge(spark, d):
    t = read_table(spark, d, "to_description")
    o, v = F.coalesce("ocr_text", F.lit("")) != "", F.coalesce("vlm_description", F.lit("")) != ""
    engine, text = M.fuse(o, F.col("ocr_text"), v, F.col("vlm_description"), F.expr(_D))
    return t.select("image_id", engine.alias("engine"), F.length(text).alias("n"))


def stub_ocr(values: list) -> list:
    """Fails on texts whose length is divisible by 7, reads others as their first 20 characters."""
    out = []
    for v in values:
        if v is not None and len(v) % 7 == 0:
            raise ValueError("cannot read image")
        out.append(None if v is None else v[:20])
    return out


@query("stub_extract", "SELECT doc_id, NOT coalesce(length(text) % 7 = 0, false) AS ok, CASE WHEN length(text) % 7 <> 0 THEN left(text, 20) END AS data, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: cannot read image' END AS error FROM documents")
def stub_extract(spark, d):
    return M.batch_call(read_table(spark, d, "documents"), "doc_id", "text", stub_ocr)


@query("cached_extract", "SELECT doc_id, NOT length(text) % 7 = 0 AS ok, CASE WHEN length(text) % 7 <> 0 THEN left(text, 20) END AS data FROM documents WHERE text IS NOT NULL")
def cached_extract(spark, d):
    docs = read_table(spark, d, "documents").filter("text IS NOT NULL")
    cache = docs.filter("length(text) % 7 <> 0 AND lang = 'en'").select(F.sha2("text", 256).alias("h"), F.substring("text", 1, 20).alias("data")).dropDuplicates(["h"])
    return M.cached_call(docs, "doc_id", "text", cache, stub_ocr).select("doc_id", "ok", "data")


@query("embed_stub_index")
def embed_stub_index(spark, d):
    return M.embed(read_table(spark, d, "documents"), "doc_id", "text")


@query("ocr_probe", "SELECT leaflet_key, CAST(coalesce(sum(length(ocr_text)), 0) AS BIGINT) AS chars, round(coalesce(avg(CASE WHEN ok THEN 0.9 ELSE 0.1 END), 0.0), 4) AS conf FROM to_description GROUP BY leaflet_key")
def ocr_probe(spark, d):
    return read_table(spark, d, "to_description").groupBy("leaflet_key").agg(F.coalesce(F.sum(F.length("ocr_text")), F.lit(0)).alias("chars"), F.round(F.coalesce(F.avg(F.when(F.col("ok"), 0.9).otherwise(0.1)), F.lit(0.0)), 4).alias("conf"))


sql_query("blank_drop", r"SELECT doc_id FROM documents WHERE text rlike r'(?U)\S'", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\t-\r\x{85}\p{Z}]')")
sql_query("size_limit", "SELECT doc_id, CASE WHEN length(text) > 5000 THEN 413 WHEN length(text) = 0 OR text IS NULL THEN 422 ELSE 200 END AS status FROM documents")
sql_query("risky_tools", "SELECT name, name rlike 'create|write|delete|update|move|send|edit' AS risky FROM (VALUES ('fs_write'), ('fs_read'), ('delete_all'), ('search')) AS t(name)", "SELECT name, regexp_matches(name, 'create|write|delete|update|move|send|edit') AS risky FROM (VALUES ('fs_write'), ('fs_read'), ('delete_all'), ('search')) AS t(name)")
