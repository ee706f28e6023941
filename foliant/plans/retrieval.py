"""Queries over sparse and dense retrieval."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import HAN_RUN
from foliant.operators import layout as L
from foliant.operators import retrieval as R
from foliant.plans.layout import _CHUNKS, packed_chunks
from foliant.registry import query, spark_sql, sql_query
from foliant.session import read_table


def _tok(table: str, key: str, text: str, weight: str = "1") -> str:
    """SQL of the tokens of a text: words, and the 2-4-grams of ideograph runs."""
    return f"""SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+', 0)) AS term, {weight} AS w FROM {table} WHERE {text} IS NOT NULL
 UNION ALL SELECT {key}, substr(run, i, n) AS term, {weight} AS w FROM (SELECT {key}, run, n, unnest(range(1, length(run) - n + 2)) AS i
  FROM (SELECT {key}, run, unnest([2, 3, 4]) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '{HAN_RUN}', 0)) AS run FROM {table} WHERE {text} IS NOT NULL)) WHERE length(run) >= n)"""


_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM ({_tok('documents', 'doc_id', 'text')}) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
_IDF = f"{_TF}, i AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM df)"


def _tf(spark, d):
    return R.term_frequency(read_table(spark, d, "documents"), "doc_id", {"text": 1})


@query("tfidf_tokens", f"WITH {_TF} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n_tokens, count(*) AS n_terms FROM tf GROUP BY doc_id")
def tfidf_tokens(spark, d):
    return _tf(spark, d).groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"))


@query("tfidf_df", f"WITH {_TF} SELECT * FROM df")
def tfidf_df(spark, d):
    return R.document_frequency(_tf(spark, d))


@query("tfidf_idf", f"WITH {_IDF} SELECT term, round(idf, 6) AS idf FROM i")
def tfidf_idf(spark, d):
    docs = read_table(spark, d, "documents")
    return R.idf(R.document_frequency(_tf(spark, d)), docs.count()).select("term", F.round("idf", 6).alias("idf"))


@query("tfidf_vectors", f"""WITH {_IDF}, x AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS x FROM tf JOIN i USING (term)), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY doc_id)
 SELECT doc_id, term, round(x / norm, 6) AS w FROM x JOIN n USING (doc_id)""")
def tfidf_vectors(spark, d):
    docs = read_table(spark, d, "documents")
    tf = _tf(spark, d)
    return R.normalised(tf, R.term_weights(tf, docs.count()), "doc_id").select("doc_id", "term", F.round("w", 6).alias("w"))


def _search_sql(docs: str, key: str, k: int, least: float, prefix: str) -> str:
    """docs: a table expression (key, text); queries are the catalogue's generic names."""
    return f"""{prefix} tf AS (SELECT {key}, term, CAST(sum(w) AS BIGINT) AS tf FROM ({_tok(docs, key, 'text')}) GROUP BY {key}, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM {docs})) / (1.0 + df)) + 1.0 AS idf FROM df),
 x AS (SELECT {key}, term, (1 + ln(tf)) * idf AS x FROM tf JOIN i USING (term)), n AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM x GROUP BY {key}), dv AS (SELECT {key}, term, x / norm AS w FROM x JOIN n USING ({key})),
 qtf AS (SELECT drug_id, term, count(*) AS tf FROM ({_tok('drug_catalogue', 'drug_id', 'generic_name')}) GROUP BY drug_id, term),
 qx AS (SELECT drug_id, term, (1 + ln(tf)) * idf AS x FROM qtf JOIN i USING (term)), qn AS (SELECT drug_id, sqrt(sum(x * x)) AS norm FROM qx GROUP BY drug_id), qv AS (SELECT drug_id, term, x / norm AS w FROM qx JOIN qn USING (drug_id)),
 s AS (SELECT drug_id, {key}, round(sum(dv.w * qv.w), 6) AS score FROM dv JOIN qv USING (term) GROUP BY drug_id, {key}),
 rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY drug_id ORDER BY score DESC, {key}) AS INT) AS rank FROM s WHERE score >= {least}) SELECT * FROM rk WHERE rank <= {k}"""


@query("sparse_topk", _search_sql("documents", "doc_id", 8, 0.05, "WITH"))
def sparse_topk(spark, d):
    return R.sparse_top(read_table(spark, d, "drug_catalogue"), read_table(spark, d, "documents"), "drug_id", "generic_name", "doc_id", {"text": 1})


@query("sparse_threshold_only", _search_sql("documents", "doc_id", 6, 0.06, "WITH"))
def sparse_threshold_only(spark, d):
    return R.sparse_top(read_table(spark, d, "drug_catalogue"), read_table(spark, d, "documents"), "drug_id", "generic_name", "doc_id", {"text": 1}, k=6, least=0.06)


@query("chunk_sparse_topk", _search_sql("ch", "chunk", 8, 0.05, f"{_CHUNKS}, ch AS (SELECT doc_id || ':' || chunk_no AS chunk, content AS text FROM c),"))
def chunk_sparse_topk(spark, d):
    """Flagship: documents are packed into chunks, the chunks are searched with the catalogue's names."""
    ch = packed_chunks(spark, d).select(F.concat_ws(":", "doc_id", "chunk_no").alias("chunk"), F.col("content").alias("text"))
    return R.sparse_top(read_table(spark, d, "drug_catalogue"), ch, "drug_id", "generic_name", "chunk", {"text": 1})


@query("field_weighted_tf", f"""SELECT p_partkey, term, CAST(sum(w) AS BIGINT) AS tf FROM (SELECT * FROM ({_tok('part', 'p_partkey', 'p_name', '3')}) UNION ALL SELECT * FROM ({_tok('part', 'p_partkey', 'p_brand', '2')}) UNION ALL SELECT * FROM ({_tok('part', 'p_partkey', 'p_type', '1')})) GROUP BY p_partkey, term""")
def field_weighted_tf(spark, d):
    return R.term_frequency(read_table(spark, d, "part"), "p_partkey", {"p_name": 3, "p_brand": 2, "p_type": 1})


_NORM = "e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-12)) AS v FROM embeddings)"


@query("dense_topk", f"""WITH {_NORM}, s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, round(list_inner_product(q.v, d.v), 6) AS score FROM e q, e d WHERE q.vec_id % 100 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def dense_topk(spark, d):
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    e = read_table(spark, d, "embeddings")
    return R.dense_top(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, "query_id", "vec_id", "embedding")


@query("dense_normalise", f"WITH {_NORM} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1], 6) AS first FROM e")
def dense_normalise(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    e = read_table(spark, d, "embeddings").select("vec_id", v.alias("v"), norm.alias("n")).select("vec_id", F.expr("transform(v, x -> x / n)").alias("v"))
    return e.select("vec_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


_TOOLS = "(VALUES (1, 'my_api_x'), (2, 'my_y'), (3, 'z'), (4, 'fs_read_file'), (5, 'fs_write'), (6, 'other_tool')) AS t(seq, name)"
_SERVERS = "(VALUES ('my'), ('my_api'), ('fs'), ('empty')) AS s(server)"


@query("tool_prefix_match", f"SELECT seq, name, (SELECT server FROM {_SERVERS} WHERE starts_with(name, server || '_') ORDER BY length(server) DESC LIMIT 1) AS server FROM {_TOOLS}")
def tool_prefix_match(spark, d):
    return R.longest_prefix(spark.sql(f"SELECT * FROM {_TOOLS}"), "name", spark.sql(f"SELECT * FROM {_SERVERS}"), "server")


@query("tools_by_server", f"""WITH m AS (SELECT name, (SELECT server FROM {_SERVERS} WHERE starts_with(name, server || '_') ORDER BY length(server) DESC LIMIT 1) AS server FROM {_TOOLS})
 SELECT coalesce(s.server, m.server) AS server, count(m.name) AS n_tools, coalesce(string_agg(m.name, ',' ORDER BY m.name), '') AS tools FROM m FULL JOIN (SELECT * FROM {_SERVERS}) s ON s.server = m.server GROUP BY coalesce(s.server, m.server)""")
def tools_by_server(spark, d):
    m = tool_prefix_match(spark, d).select("name", "server")
    s = spark.sql(f"SELECT * FROM {_SERVERS}")
    return s.join(m, "server", "full_outer").groupBy("server").agg(F.count("name").alias("n_tools"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("tools"))


sql_query("tool_semi_join", f"SELECT k.rank, k.name FROM (VALUES (1, 'fs_write'), (2, 'gone'), (3, 'z')) AS k(rank, name) WHERE k.name IN (SELECT name FROM {_TOOLS}) ORDER BY k.rank")
sql_query("unknown_tool", f"SELECT k.rank, k.name, CASE WHEN t.name IS NULL THEN 'UNKNOWN_TOOL' END AS code FROM (VALUES (1, 'fs_write'), (2, 'gone'), (3, 'z')) AS k(rank, name) LEFT JOIN (SELECT name FROM {_TOOLS}) t ON t.name = k.name")
_EXP = "(VALUES (1, '文件', 'file read'), (2, '天气', 'weather'), (3, 'file', 'read write'), (4, '搜索', 'search')) AS x(expand_seq, k, words)"
_QS = "(VALUES (1, '读取文件内容'), (2, 'open the FILE 文件'), (3, '你好呀'), (4, '今天天气')) AS q(query_id, query)"
sql_query("query_expand",
          f"SELECT q.query_id, concat_ws(' ', q.query, array_join(transform(array_sort(collect_list(CASE WHEN x.k IS NOT NULL THEN struct(x.expand_seq, x.words) END)), y -> y.words), ' ')) AS expanded FROM {_QS} LEFT JOIN {_EXP} ON contains(lower(q.query), x.k) GROUP BY q.query_id, q.query".replace("concat_ws(' ', q.query, ", "trim(concat(q.query, ' ', ").replace(", ' ')) AS expanded", ", ' '))) AS expanded"),
          f"SELECT q.query_id, trim(q.query || ' ' || coalesce(string_agg(x.words, ' ' ORDER BY x.expand_seq), '')) AS expanded FROM {_QS} LEFT JOIN {_EXP} ON contains(lower(q.query), x.k) GROUP BY q.query_id, q.query")


@query("cjk_ngrams", f"SELECT query_id, term, count(*) AS n FROM ({_tok('(SELECT * FROM ' + _QS + ')', 'query_id', 'query')}) GROUP BY query_id, term")
def cjk_ngrams(spark, d):
    from foliant.functions.text import tokens

    return spark.sql(f"SELECT * FROM {_QS}").select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))




@query("map_topn", f"WITH {_TF}, r AS (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS rn FROM tf) SELECT doc_id, string_agg(term || '=' || tf, ' ' ORDER BY rn) AS top FROM r WHERE rn <= 8 GROUP BY doc_id")
def map_topn(spark, d):
    """The 8 heaviest tokens of each document's token map."""
    return _tf(spark, d).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("m")).select(
        "doc_id", F.expr("array_join(transform(slice(array_sort(map_entries(m), (a, b) -> CASE WHEN a.value <> b.value THEN int(sign(b.value - a.value)) WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END), 1, 8), e -> concat(e.key, '=', e.value)), ' ')").alias("top"))
