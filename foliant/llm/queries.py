"""Queries of this subpackage and the SQL that states the same, where SQL can on whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import lookalikes, neardup, neighbors, packing, pii, scans, splitting, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": scans.p1_found, "p1_repaired": scans.p1_repaired,
        "p2_found": neighbors.p2_found, "p2_neighbors": neighbors.p2_neighbors,
        "p3_found": splitting.p3_found, "p3_pieces": splitting.p3_pieces,
        "p4_found": neardup.p4_found, "p4_groups": neardup.p4_groups,
        "p5_found": lookalikes.p5_found, "p5_forms": lookalikes.p5_forms, "p5_names": lookalikes.p5_names, "p5_classes": lookalikes.p5_classes,
        "p6_ids": tokens.p6_ids, "p6_token_counts": tokens.p6_token_counts,
        "p7_containers": packing.p7_containers,
        "p8_found": pii.p8_found, "p8_masked": pii.p8_masked,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH v AS (SELECT vec_id, CAST(dense AS DOUBLE[]) AS d FROM embed_response WHERE len(dense) = 64 AND len(list_filter(dense, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
            u AS (SELECT vec_id, list_transform(d, lambda x: x / sqrt(list_inner_product(d, d))) AS d FROM v),
            s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.d, b.d) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),
            r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS n FROM s WHERE c >= 0.9)
            SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE n <= 10""",
        "p3_found": r"""
            WITH t AS (SELECT chunk_key, content FROM chunks WHERE type = 'text' AND length(content) > 600),
            s AS (
              SELECT chunk_key, unnest(string_split_regex(
                regexp_replace(regexp_replace(content, '([。！？；])', '\1' || chr(10), 'g'), '([.!?]) ', '\1' || chr(10) || ' ', 'g'), chr(10))) AS stretch
              FROM t)
            SELECT chunk_key, CASE WHEN max(length(regexp_replace(stretch, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))) > 600 THEN 'forced' ELSE 'natural' END AS cut
            FROM s GROUP BY chunk_key""",
        "p4_found": """
            WITH t AS (SELECT chunk_key, content FROM chunks WHERE type = 'text' AND length(content) >= 200),
            s AS (SELECT DISTINCT chunk_key, substr(content, i, 4) AS g FROM (SELECT chunk_key, content, unnest(range(1, length(content) - 2)) AS i FROM t)),
            n AS (SELECT chunk_key, count(*) AS n FROM s GROUP BY chunk_key),
            o AS (SELECT a.chunk_key AS a, b.chunk_key AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.chunk_key < b.chunk_key GROUP BY a.chunk_key, b.chunk_key)
            SELECT a AS chunk_a, b AS chunk_b FROM o JOIN n x ON x.chunk_key = a JOIN n y ON y.chunk_key = b WHERE o / (x.n + y.n - o)::DOUBLE >= 0.8""",
    }
