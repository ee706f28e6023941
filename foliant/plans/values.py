"""Scalar operators on inline rows and event properties."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import scalars as S
from foliant.functions import text as T
from foliant.registry import query, sql_query
from foliant.session import read_table

sql_query("json_path", "SELECT event_id, try_cast(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
_W = """(VALUES (1, '{"current_condition":[{"weatherDesc":[{"value":"Sunny"}],"temp_C":"21"}]}'), (2, '{"current_condition":[]}'), (3, '{}')) AS w(id, j)"""
sql_query("json_weather", f"SELECT id, coalesce(get_json_object(j, '$.current_condition[0].weatherDesc[0].value'), 'error: missing field') AS sky FROM {_W}",
          f"SELECT id, coalesce(json_extract_string(j, '$.current_condition[0].weatherDesc[0].value'), 'error: missing field') AS sky FROM {_W}")
_A = """(VALUES (1, '{"features":[{"properties":{"event":"Wind","area":"A"}},{"properties":{"event":"Rain","area":"B"}}]}'), (2, '{"features":[]}')) AS a(id, j)"""
sql_query("json_alerts_top5",
          f"SELECT id, CASE WHEN size(f) = 0 THEN 'no active alerts' ELSE array_join(transform(slice(f, 1, 5), x -> concat(x.properties.event, ': ', x.properties.area)), '\\n') END AS text FROM (SELECT id, from_json(j, 'features array<struct<properties: struct<event: string, area: string>>>').features AS f FROM {_A})",
          f"""SELECT id, coalesce((SELECT string_agg(json_extract_string(x, '$.properties.event') || ': ' || json_extract_string(x, '$.properties.area'), chr(10)) FROM (SELECT unnest(list_slice(CAST(json_extract(j, '$.features') AS JSON[]), 1, 5)) AS x)), 'no active alerts') AS text FROM {_A}""")
_S = """(VALUES (1, '{"type":"object","properties":{"city":{"type":"string"},"days":{"type":"integer"}}}'), (2, '{"type":"object"}')) AS s(id, j)"""
sql_query("schema_params", f"SELECT id, coalesce(array_join(json_object_keys(get_json_object(j, '$.properties')), ','), '') AS params FROM {_S}",
          f"SELECT id, coalesce(array_to_string(json_keys(j, '$.properties'), ','), '') AS params FROM {_S}")
_L = """(VALUES (1, '```json\n{"passed": true, "feedback": " ok "}\n```'), (2, 'text {"passed": false, "feedback": "bad"} tail'), (3, 'no json'), (4, '{"passed": 1}')) AS l(id, t)"""
sql_query("lenient_json",
          f"SELECT id, lower(get_json_object(j, '$.passed')) IN ('true', '1') AND j IS NOT NULL AS passed, trim(coalesce(get_json_object(j, '$.feedback'), CASE WHEN j IS NULL THEN t ELSE '' END)) AS feedback FROM (SELECT id, t, coalesce(CASE WHEN try_parse_json(c) IS NOT NULL THEN c END, nullif(regexp_extract(c, r'(?s)\\{{.*\\}}', 0), '')) AS j FROM (SELECT id, t, trim(regexp_replace(t, r'(?s)^```(?:json)?\\s*|\\s*```$', '')) AS c FROM {_L}))".replace("lower(get_json_object(j, '$.passed')) IN ('true', '1') AND j IS NOT NULL", "coalesce(lower(get_json_object(j, '$.passed')) IN ('true', '1'), false)"),
          f"SELECT id, coalesce(lower(json_extract_string(j, '$.passed')) IN ('true', '1'), false) AS passed, trim(coalesce(json_extract_string(j, '$.feedback'), CASE WHEN j IS NULL THEN t ELSE '' END)) AS feedback FROM (SELECT id, t, coalesce(CASE WHEN json_valid(c) THEN c END, nullif(regexp_extract(c, '(?s)\\{{.*\\}}', 0), '')) AS j FROM (SELECT id, t, trim(regexp_replace(t, '(?s)^```(?:json)?\\s*|\\s*```$', '', 'g')) AS c FROM {_L}))")
sql_query("validate_args",
          "SELECT event_id, CASE WHEN k IS NULL THEN 'k: missing' WHEN k <= 0 THEN 'k: must be > 0' WHEN k > 90 THEN 'k: too large' END AS problem FROM (SELECT event_id, try_cast(get_json_object(props, '$.k') AS INT) AS k FROM events) AS e",
          "SELECT event_id, CASE WHEN k IS NULL THEN 'k: missing' WHEN k <= 0 THEN 'k: must be > 0' WHEN k > 90 THEN 'k: too large' END AS problem FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) AS e")
sql_query("canonical_json", "SELECT event_id, to_json(map_from_entries(array_sort(map_entries(from_json(props, 'map<string,int>'))))) AS j FROM events", "SELECT event_id, replace(props, ' ', '') AS j FROM events")
_R = "(VALUES (1, 'Thought: need data\nmore\nAction: search[weather in X]'), (2, 'Thought: done\nAction: Finish[it is\nfine]'), (3, 'nothing')) AS r(id, t)"
sql_query("react_parse",
          rf"SELECT id, trim(regexp_extract(t, r'(?s)Thought:\s*(.*?)(?:\nAction:|\z)', 1)) AS thought, regexp_extract(t, r'(?s)Action:\s*(\w+)\[', 1) AS tool, regexp_extract(t, r'(?s)Action:\s*\w+\[(.*)\]', 1) AS input FROM {_R}".replace("\n", "\\n"),
          rf"SELECT id, trim(regexp_extract(t, '(?s)Thought:\s*(.*?)(?:\nAction:|$)', 1)) AS thought, regexp_extract(t, '(?s)Action:\s*(\w+)\[', 1) AS tool, regexp_extract(t, '(?s)Action:\s*\w+\[(.*)\]', 1) AS input FROM {_R}")
_P = "(VALUES (1, 'plan:\n```python\n[\"a b\", \"c\"]\n```'), (2, 'no plan'), (3, '```python\nnot a list\n```')) AS p(id, t)"


@query("plan_parse", f"SELECT id, CASE id WHEN 1 THEN 'a b|c' ELSE '' END AS steps FROM {_P}")
def plan_parse(spark, d):
    return spark.sql(f"SELECT * FROM {_P}".replace("\n", "\\n")).select("id", F.array_join(S.plan_list_udf("t"), "|").alias("steps"))


_B = "(VALUES (1, '- a\n-  b\n\nc'), (2, '')) AS b(id, t)"
sql_query("bullets", f"SELECT id, array_join(filter(transform(split(t, '\\n'), x -> trim(regexp_replace(x, '^[- ]+', ''))), x -> x <> ''), '|') AS items FROM {_B}".replace("- a\n-  b\n\nc", "- a\\n-  b\\n\\nc"),
          f"SELECT id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '^[- ]+', ''))), lambda x: x <> ''), '|') AS items FROM {_B}")
sql_query("rule_check", "SELECT id, CASE WHEN contains(task, '21+21') THEN contains(output, '42') AND output rlike '(=|is|为) ?42' ELSE true END AS passed FROM (VALUES (1, 'compute 21+21', 'the sum is 42'), (2, 'compute 21+21', '43'), (3, 'other', 'x'), (4, '21+21', '42')) AS t(id, task, output)",
          "SELECT id, CASE WHEN contains(task, '21+21') THEN contains(output, '42') AND regexp_matches(output, '(=|is|为) ?42') ELSE true END AS passed FROM (VALUES (1, 'compute 21+21', 'the sum is 42'), (2, 'compute 21+21', '43'), (3, 'other', 'x'), (4, '21+21', '42')) AS t(id, task, output)")
sql_query("calc_ops", "SELECT a, b, op, CASE op WHEN 'add' THEN a + b WHEN 'sub' THEN a - b WHEN 'mul' THEN a * b WHEN 'div' THEN CASE WHEN b <> 0 THEN a / b END END AS v, CASE WHEN op = 'div' AND b = 0 THEN 'division by zero' WHEN op NOT IN ('add', 'sub', 'mul', 'div') THEN 'VALIDATION_ERROR' END AS error FROM (VALUES (CAST(6 AS DOUBLE), CAST(3 AS DOUBLE)), (CAST(1 AS DOUBLE), CAST(0 AS DOUBLE))) AS x(a, b), (VALUES ('add'), ('sub'), ('mul'), ('div'), ('mod')) AS o(op)")
_M = "(event_id % 7)"


@query("calc_expr", f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'error: ZeroDivisionError' WHEN event_id % 13 = 0 THEN 'error: ValueError'
 ELSE CAST(event_id + user_id * 3 - ((CAST(floor((5 - {_M}) / 4.0) AS BIGINT) % 5) + 5) % 5 + CAST(pow(2, {_M}) AS BIGINT) * -(event_id // 10 - 3) AS VARCHAR) END AS v FROM events""")
def calc_expr(spark, d):
    """Arithmetic texts made of the event's numbers; some divide by zero, some are no arithmetic."""
    text = f"CASE WHEN event_id % 11 = 0 THEN concat(event_id, ' / (', {_M}, ' - ', {_M}, ')') WHEN event_id % 13 = 0 THEN concat('__import__(', event_id, ')') ELSE concat(event_id, '+', user_id, ' * 3 - (5 - ', {_M}, ') // 4 % 5 + 2 ** ', {_M}, ' * -(', event_id, '//10-3)') END"
    return read_table(spark, d, "events").select("event_id", S.evaluate_udf(F.expr(text)).alias("v"))


sql_query("time_zone", "SELECT event_id, date_format(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Shanghai'), 'yyyy-MM-dd HH:mm:ss') AS local FROM events",
          "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")
sql_query("answer_coalesce", r"SELECT image_id, coalesce(nullif(trim(vlm_description), ''), nullif(trim(error), ''), '(no answer)') AS a FROM to_description")
sql_query("search_format", "SELECT id, coalesce(answer, array_join(transform(results, x -> concat('- ', x)), '\\n'), 'nothing found') AS t FROM (VALUES (1, 'direct', array('a')), (2, NULL, array('a', 'b')), (3, NULL, NULL)) AS s(id, answer, results)",
          "SELECT id, coalesce(answer, array_to_string(list_transform(results, lambda x: '- ' || x), chr(10)), 'nothing found') AS t FROM (VALUES (1, 'direct', ['a']), (2, NULL, ['a', 'b']), (3, NULL, NULL)) AS s(id, answer, results)")
sql_query("error_render", "SELECT id, concat('Error(', code, '): ', type, ': ', array_join(transform(errs, e -> concat(e.loc, ': ', e.msg)), '; ')) AS text FROM (VALUES (1, 'VALIDATION_ERROR', 'ValueError', array(named_struct('loc', 'a', 'msg', 'missing'), named_struct('loc', 'b', 'msg', 'too small')))) AS t(id, code, type, errs)",
          "SELECT id, 'Error(' || code || '): ' || type || ': ' || array_to_string(list_transform(errs, lambda e: e.loc || ': ' || e.msg), '; ') AS text FROM (VALUES (1, 'VALIDATION_ERROR', 'ValueError', [{'loc': 'a', 'msg': 'missing'}, {'loc': 'b', 'msg': 'too small'}])) AS t(id, code, type, errs)")
sql_query("result_text", "SELECT chunk_key, coalesce(caption, content, section, 'null') AS t FROM chunks")
sql_query("null_strip", "SELECT doc_id, to_json(named_struct('doc_id', doc_id, 'lang', lang, 'leaflet_no', leaflet_no)) AS j FROM documents",
          """SELECT doc_id, '{"doc_id":' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE ',"lang":"' || lang || '"' END || CASE WHEN leaflet_no IS NULL THEN '' ELSE ',"leaflet_no":"' || leaflet_no || '"' END || '}' AS j FROM documents""")
sql_query("sparse_cast", "SELECT event_id, element_at(transform_values(from_json(props, 'map<string,float>'), (k, v) -> CAST(v AS DOUBLE)), 'k') AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
_ENV = "(VALUES (1, 'A=1'), (2, '# c'), (3, 'B=\"x=y\"'), (4, 'plain'), (5, ' C = z '), (6, 'D=abc')) AS e(n, line)"
sql_query("dotenv_parse", f"""SELECT trim(substring_index(line, '=', 1)) AS k, trim(BOTH '"' FROM trim(substr(line, instr(line, '=') + 1))) AS v, coalesce(try_cast(trim(substr(line, instr(line, '=') + 1)) AS INT), 7) AS as_int FROM {_ENV} WHERE line LIKE '%=%' AND NOT startswith(trim(line), '#')""",
          f"""SELECT trim(string_split(line, '=')[1]) AS k, trim(trim(substr(line, instr(line, '=') + 1)), '"') AS v, coalesce(TRY_CAST(trim(substr(line, instr(line, '=') + 1)) AS INT), 7) AS as_int FROM {_ENV} WHERE line LIKE '%=%' AND NOT starts_with(trim(line), '#')""")
# Rows of the tables in the chunks: cells with outer blanks, pipes and line breaks, null cells, ragged rows.
_TABLE = r"transform(filter(split(content, '\\n'), l -> startswith(l, '|') AND NOT startswith(l, '| ---')), (l, i) -> transform(split(substr(l, 3, length(l) - 4), ' [|] '), (c, j) -> CASE WHEN c = '' THEN NULL WHEN (i + j) % 9 = 0 THEN concat(' ', c, '|x\ny ') ELSE c END))"
_DUCK_TABLE = """(SELECT chunk_key, list_transform(list_filter(string_split(content, chr(10)), lambda l: starts_with(l, '|') AND NOT starts_with(l, '| ---')), lambda l, i: list_transform(string_split(l[3:-3], ' | '), lambda c, j: CASE WHEN c = '' THEN NULL WHEN (i + j - 2) % 9 = 0 THEN ' ' || c || '|x' || chr(10) || 'y ' ELSE c END)) AS r FROM chunks WHERE type = 'table')"""


def _rows(spark, d):
    t = read_table(spark, d, "chunks").filter("type = 'table'").select("chunk_key", F.expr(_TABLE).alias("r"))
    return t.withColumn("r", F.transform("r", lambda x, i: F.when(i == 1, F.slice(x, 1, 1)).otherwise(x)))


_RAGGED = f"(SELECT chunk_key, list_transform(r, lambda x, i: CASE WHEN i = 2 THEN x[1:1] ELSE x END) AS r FROM {_DUCK_TABLE})"


@query("markdown_table", f"""WITH t AS (SELECT chunk_key, r, list_max(list_transform(r, lambda x: len(x))) AS w FROM {_RAGGED}),
 l AS (SELECT chunk_key, w, list_transform(r, lambda x: '| ' || array_to_string(list_transform(range(1, w + 1), lambda k: coalesce(replace(replace(trim(x[k]), chr(10), '<br>'), '|', '\\|'), '')), ' | ') || ' |') AS s FROM t)
 SELECT chunk_key, array_to_string(list_concat([s[1], '| ' || array_to_string(list_transform(range(w), lambda k: '---'), ' | ') || ' |'], s[2:]), chr(10)) AS md FROM l""")
def markdown_table(spark, d):
    return _rows(spark, d).select("chunk_key", T.markdown_table(F.col("r")).alias("md"))


@query("norm_rows", f"SELECT chunk_key, array_to_string(list_transform(r, lambda x: array_to_string(list_transform(x, lambda c: trim(replace(coalesce(c, ''), chr(10), ''))), '|')), '/') AS r FROM {_RAGGED}")
def norm_rows(spark, d):
    return _rows(spark, d).select("chunk_key", F.array_join(F.transform("r", T.norm_row), "/").alias("r"))
