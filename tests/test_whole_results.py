"""Whole results: texts that queries pass on are not shortened."""
import json
from collections import defaultdict

import pyarrow.parquet as pq

from foliant import catalog
from tests.harness import SF

Q = catalog.queries()


def without_nulls(v):
    return {k: without_nulls(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v


def test_layout_json_has_whole_chunks(spark):
    cols = ["id", "type", "section", "sub_section", "caption", "content", "page_start", "page_end", "char_len", "meta"]
    want = defaultdict(list)
    for r in pq.read_table(f"{SF}/chunks.parquet", columns=["leaflet_key", *cols]).to_pylist():
        want[r.pop("leaflet_key")].append(without_nulls(r))
    by = lambda chunks: sorted(chunks, key=lambda c: json.dumps(c, sort_keys=True))
    got = {r.leaflet_key: json.loads(r.json) for r in Q["layout_json"](spark, SF).collect()}
    assert {k: by(v) for k, v in got.items()} == {k: by(v) for k, v in want.items()}
    assert all([c["id"] for c in v] == sorted(c["id"] for c in v) for v in got.values())


def test_token_concat_has_whole_parts(spark):
    want = defaultdict(list)
    for r in pq.read_table(f"{SF}/chunks.parquet", columns=["leaflet_key", "chunk_key", "content"]).to_pylist():
        if r["content"]:
            want[r["leaflet_key"]].append((r["chunk_key"], r["content"]))
    got = {r.leaflet_key: (r.n, r.stream) for r in Q["token_concat"](spark, SF).collect()}
    assert got == {k: (len(v), "".join(c for _, c in sorted(v))) for k, v in want.items()}


def test_step_context_has_whole_results(spark):
    steps = defaultdict(list)
    for r in Q["chat_turns"](spark, SF).filter("role = 'assistant'").orderBy("doc_id", "turn").collect():
        steps[r.doc_id].append((r.turn, r.content))
    got = {(r.doc_id, r.turn): r.context for r in Q["step_context"](spark, SF).collect()}
    want = {(k, t): " | ".join(f"step_{u}: {c}" for u, c in v[:i]) for k, v in steps.items() for i, (t, _) in enumerate(v)}
    assert got == want and any(len(c) > 30 for v in steps.values() for _, c in v[:-1])


def test_newest_parse_keeps_documents_with_ties(spark, tmp_path):
    rows = [("a", 1, 10), ("a", 2, 10), ("a", 3, 20), ("b", 7, 30), ("b", 6, 30), ("c", 9, 5), ("c", 9, 5), ("d", 4, None), ("d", 5, 1)]
    df = spark.createDataFrame(rows, "doc_id string, leaflet_key long, s long").selectExpr("leaflet_key", "named_struct('doc_id', doc_id) AS meta", "timestamp_seconds(s) AS parsed_at")
    df.write.parquet(str(tmp_path / "leaflets.parquet"))
    assert {r.doc_id: r.newest for r in Q["newest_parse"](spark, str(tmp_path)).collect()} == {"a": 3, "b": 7, "c": 9, "d": 5}


def test_document_rule_score_reads_the_characters(spark):
    """The same statement with entropy and variance of the characters, on another engine."""
    from foliant.plans.routing import _SCORE
    from tests.harness import oracle, rows_of

    names, rows = oracle(f"""WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).', 0)) AS ch FROM documents WHERE length(text) > 0) GROUP BY doc_id, ch),
     t AS (SELECT doc_id, sum(n) AS total, sum(n * unicode(ch)::DOUBLE) / sum(n) AS mean FROM c GROUP BY doc_id),
     e AS (SELECT doc_id, -sum(n / total * log2(n / total)) AS image_entropy, sum(n / total * (unicode(ch) - mean) ** 2) AS color_variance FROM c JOIN t USING (doc_id) GROUP BY doc_id),
     f AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text)::DOUBLE AS text_ratio, image_entropy, length(regexp_replace(text, '[^.,;:]', '', 'g')) / length(text)::DOUBLE AS edge_density,
      color_variance, len(string_split(text, chr(10))) * 10 AS num_connected_components FROM documents JOIN e USING (doc_id))
     SELECT doc_id, {_SCORE} AS score FROM f""")
    got = Q["document_rule_score"](spark, SF)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, rows)
