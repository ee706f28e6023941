"""Queries over call logs; ``events`` is the log, an event of type error a failure."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import resilience as R
from foliant.registry import query, sql_query
from foliant.session import read_table

_CASES = "(VALUES (1, NULL, 'ConnectTimeout', ''), (2, NULL, 'ReadTimeout', ''), (3, NULL, 'TimeoutError', ''), (4, NULL, 'ConnectionError', ''), (5, NULL, 'ConnectionResetError', ''), (6, 429, NULL, ''), (7, 504, NULL, ''), (8, 404, NULL, ''), (9, NULL, 'ValueError', ''), (10, 500, NULL, ''), (11, NULL, 'ChunkedEncodingError', ''), (12, NULL, 'NetworkError', ''), (13, NULL, 'DnsLookupFailed', ''), (14, NULL, 'BrokenStream', ''), (15, NULL, 'apitimeouterror', ''), (16, NULL, 'OSError', 'read Timed out'), (17, NULL, 'APIConnectionError', NULL)) AS c(id, status, exc, message)"
_ERR = "CASE WHEN {s} IN (429, 503) THEN 'SAFE' WHEN {s} = 504 THEN 'UNKNOWN' WHEN {s} >= 500 THEN 'SAFE' WHEN {s} IS NOT NULL THEN 'NO' WHEN {x} = 'ConnectTimeout' THEN 'SAFE' WHEN {x} IN ('ConnectionResetError', 'BrokenPipeError', 'ChunkedEncodingError') THEN 'UNKNOWN' WHEN regexp_matches(lower({x}), 'timeout') OR regexp_matches(lower({m}), 'timed out') THEN 'UNKNOWN' WHEN regexp_matches(lower({x}), 'connection|network|dns') THEN 'SAFE' WHEN regexp_matches(lower({x}), 'reset|broken|chunked') THEN 'UNKNOWN' ELSE 'NO' END"


@query("error_class", f"SELECT id, {_ERR.format(s='status', x='exc', m='message')} AS class FROM {_CASES}")
def error_class(spark, d):
    return spark.sql(f"SELECT * FROM {_CASES}").select("id", R.error_class(F.col("status"), F.col("exc"), F.col("message")).alias("class"))


_STATUS = "CASE WHEN event_type = 'error' THEN 400 + (event_id * 7) % 110 END"


@query("event_error_class", f"SELECT event_id, {_ERR.format(s='(' + _STATUS + ')', x='event_type', m="''")} AS class FROM events WHERE event_type = 'error'")
def event_error_class(spark, d):
    return read_table(spark, d, "events").filter("event_type = 'error'").select("event_id", R.error_class(F.expr(_STATUS), F.col("event_type")).alias("class"))


sql_query("retry_schedule", "SELECT base, attempt, round(base * pow(2.0, attempt), 4) AS delay_s FROM (VALUES (0.5), (1.0)) AS b(base), (VALUES (0), (1), (2), (3)) AS a(attempt)")
sql_query("retryable", "SELECT id, exc IN ('ConnectTimeout', 'ReadTimeout', 'ConnectionError', 'TimeoutError') OR coalesce(status >= 500, false) AS retry FROM " + _CASES,
          "SELECT id, coalesce(exc IN ('ConnectTimeout', 'ReadTimeout', 'ConnectionError', 'TimeoutError'), NULL) OR coalesce(status >= 500, false) AS retry FROM " + _CASES)


def _log(spark, d):
    return read_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", (F.col("event_type") == "error").alias("failed"))


_RUNS = """e AS (SELECT user_id, ts, event_id, event_type, event_type = 'error' AS failed FROM events),
 c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR failed IS DISTINCT FROM lag(failed) OVER w THEN 1 ELSE 0 END AS ch FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM c),
 g AS (SELECT user_id, run, event_type, failed, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY ALL)"""


@query("failure_runs", f"WITH {_RUNS} SELECT * FROM g WHERE failed")
def failure_runs(spark, d):
    return R.failure_runs(_log(spark, d), "user_id", ["ts", "event_id"], "event_type", "failed").filter("failed")


@query("loop_hint", f"WITH {_RUNS} SELECT user_id, min(run) AS run FROM g WHERE failed AND n >= 2 GROUP BY user_id")
def loop_hint(spark, d):
    """The first run of two or more same failures of each user."""
    return R.failure_runs(_log(spark, d), "user_id", ["ts", "event_id"], "event_type", "failed").filter("failed AND n >= 2").groupBy("user_id").agg(F.min("run").alias("run"))


def _breaker_sql(probes: int) -> str:
    reject = "(r.state = 'OPEN' AND e.us - r.opened < 3600000000) OR (r.state = 'HALF_OPEN' AND r.probes <= 0)"
    half = "(r.state IN ('OPEN', 'HALF_OPEN'))"
    left = f"CASE WHEN r.state = 'OPEN' THEN {probes} ELSE r.probes END"
    return f"""WITH RECURSIVE c AS (SELECT *, {_ERR.format(s='(' + _STATUS + ')', x='event_type', m="''")} AS klass FROM events),
 e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN 'ok' WHEN klass IN ('SAFE', 'UNKNOWN') THEN 'down' ELSE 'business' END AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM c),
 r AS (SELECT user_id, event_id, rn, 'CLOSED' AS state, CASE WHEN o = 'down' THEN 1 ELSE 0 END AS fails, 0::BIGINT AS opened, 0 AS probes, true AS admitted FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.event_id, e.rn,
  CASE WHEN {reject} THEN r.state WHEN e.o = 'ok' THEN 'CLOSED' WHEN e.o = 'business' THEN CASE WHEN {half} THEN 'HALF_OPEN' ELSE r.state END WHEN {half} OR r.fails + 1 >= 2 THEN 'OPEN' ELSE 'CLOSED' END,
  CASE WHEN {reject} THEN r.fails WHEN e.o = 'ok' THEN 0 WHEN e.o = 'down' AND NOT {half} THEN r.fails + 1 ELSE r.fails END,
  CASE WHEN {reject} THEN r.opened WHEN e.o = 'down' AND ({half} OR r.fails + 1 >= 2) THEN e.us ELSE r.opened END,
  CASE WHEN {reject} THEN r.probes WHEN {half} THEN {left} - 1 ELSE 0 END, NOT ({reject})
 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT user_id, event_id AS seq, state, admitted FROM r"""


def _outcomes(spark, d):
    e = read_table(spark, d, "events")
    failed = F.col("event_type") == "error"
    return e.select("user_id", "ts", "event_id", R.outcome(failed, R.error_class(F.expr(_STATUS), F.col("event_type"))).alias("result"))


@query("breaker_fold", _breaker_sql(1))
def breaker_fold(spark, d):
    return R.breaker(_outcomes(spark, d), "user_id", "ts", "event_id", "result")


@query("breaker_fold_probes", _breaker_sql(3))
def breaker_fold_probes(spark, d):
    return R.breaker(_outcomes(spark, d), "user_id", "ts", "event_id", "result", probe_max=3)


sql_query("ledger", "SELECT user_id, round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0.0), 4) AS balance FROM events GROUP BY user_id")
sql_query("ledger_running", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance FROM events WHERE event_type = 'purchase'")
sql_query(
    "idempotent_orders",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) > 1 AS hit FROM events WHERE event_type = 'purchase'",
)
_CALL = "(SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 23 = 0 THEN 'nosuch' ELSE event_type END AS tool, CASE WHEN event_id % 19 = 0 THEN '{\"k\":' ELSE props END AS args, event_id % 17 AS m FROM events)"
sql_query("call_codes",
          f"SELECT event_id, CASE WHEN tool NOT IN ('click', 'error', 'purchase', 'signup', 'view') THEN 'UNKNOWN_TOOL' WHEN try_parse_json(args) IS NULL THEN 'INVALID_JSON' WHEN coalesce(CAST(get_json_object(args, '$.k') AS INT), -1) < 0 THEN 'VALIDATION_ERROR' WHEN event_type = 'error' THEN 'EXECUTION_ERROR' END AS code FROM {_CALL}",
          f"SELECT event_id, CASE WHEN tool NOT IN ('click', 'error', 'purchase', 'signup', 'view') THEN 'UNKNOWN_TOOL' WHEN NOT json_valid(args) THEN 'INVALID_JSON' WHEN coalesce(CAST(CASE WHEN json_valid(args) THEN json_extract_string(args, '$.k') END AS INT), -1) < 0 THEN 'VALIDATION_ERROR' WHEN event_type = 'error' THEN 'EXECUTION_ERROR' END AS code FROM {_CALL}")
sql_query("blocked_writes", """WITH b AS (SELECT user_id, min(event_id) AS first_bad FROM events WHERE event_type = 'error' GROUP BY user_id)
 SELECT e.event_id, CASE WHEN e.event_type = 'purchase' AND b.first_bad < e.event_id THEN 'BLOCKED_WRITE' ELSE 'OK' END AS code FROM events e LEFT JOIN b ON b.user_id = e.user_id""")
sql_query("turn_budget",
          "SELECT user_id, event_id, turn FROM (SELECT user_id, event_id, CAST(row_number() OVER w AS INT) AS turn, unix_micros(CAST(ts AS TIMESTAMP)) - min(unix_micros(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE turn <= 10 AND spent <= 86400000000L * 10",
          "SELECT user_id, event_id, turn FROM (SELECT user_id, event_id, CAST(row_number() OVER w AS INT) AS turn, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE turn <= 10 AND spent <= 86400000000 * 10")

_REQ = "q AS (SELECT DISTINCT request_id, arrival_ms, n_texts, dense, sparse, colbert, max_length FROM embed_requests)"
_SESS = f"{_REQ}, s AS (SELECT *, CASE WHEN arrival_ms - lag(arrival_ms) OVER w > 4 OR lag(arrival_ms) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM q WINDOW w AS (PARTITION BY dense, sparse, colbert, max_length ORDER BY arrival_ms, request_id)), b AS (SELECT *, CAST(sum(st) OVER (PARTITION BY dense, sparse, colbert, max_length ORDER BY arrival_ms, request_id) AS INT) AS batch_no FROM s)"
KEYS = ["dense", "sparse", "colbert", "max_length"]


def _requests(spark, d):
    return read_table(spark, d, "embed_requests").select("request_id", "arrival_ms", "n_texts", *KEYS).distinct()


@query("request_batches", f"WITH {_SESS} SELECT dense, sparse, colbert, max_length, batch_no, count(*) AS n_requests, CAST(sum(n_texts) AS BIGINT) AS n_texts, min(arrival_ms) AS first_ms, max(arrival_ms) AS last_ms FROM b GROUP BY dense, sparse, colbert, max_length, batch_no")
def request_batches(spark, d):
    return R.gap_batches(_requests(spark, d), KEYS, "arrival_ms", "n_texts", "request_id", 4)


def _capped_sql(target: int) -> str:
    return f"""WITH RECURSIVE {_SESS}, x AS (SELECT request_id, coalesce(n_texts, 0)::BIGINT AS n, batch_no AS session, dense, sparse, colbert, max_length, dense || ':' || sparse || ':' || colbert || ':' || coalesce(max_length, -1) || ':' || batch_no AS k, row_number() OVER (PARTITION BY dense, sparse, colbert, max_length, batch_no ORDER BY arrival_ms, request_id) AS rn FROM b),
 r AS (SELECT x.*, n AS total, 0 AS no, 0::BIGINT AS place FROM x WHERE rn = 1 UNION ALL SELECT x.*, CASE WHEN r.total >= {target} THEN x.n ELSE r.total + x.n END, CASE WHEN r.total >= {target} THEN r.no + 1 ELSE r.no END, CASE WHEN r.total >= {target} THEN 0 ELSE r.total END FROM r JOIN x ON x.k = r.k AND x.rn = r.rn + 1)"""


@query("request_batches_capped", f"{_capped_sql(32)} SELECT dense, sparse, colbert, max_length, session, request_id, no AS batch_no, place, n FROM r")
def request_batches_capped(spark, d):
    return R.capped_batches(_requests(spark, d), KEYS, "arrival_ms", "n_texts", "request_id", 4, 32)


@query("request_batches_single", f"{_capped_sql(0)} SELECT dense, sparse, colbert, max_length, session, request_id, no AS batch_no, place, n FROM r")
def request_batches_single(spark, d):
    """Target 0: one request per batch."""
    return R.capped_batches(_requests(spark, d), KEYS, "arrival_ms", "n_texts", "request_id", 4, 0)


@query("batch_hand_back", f"""{_capped_sql(32)}, sb AS (SELECT dense, sparse, colbert, max_length, session, no, sum(n) AS total, min(request_id) % 5 <> 0 AS ok FROM r GROUP BY ALL)
 SELECT r.request_id, sb.ok, CASE WHEN sb.ok THEN r.n END AS got, CASE WHEN sb.ok AND r.n > 0 THEN r.place END AS first, CASE WHEN NOT sb.ok THEN 'RuntimeError: encode' END AS error
 FROM r JOIN sb ON r.dense IS NOT DISTINCT FROM sb.dense AND r.sparse IS NOT DISTINCT FROM sb.sparse AND r.colbert IS NOT DISTINCT FROM sb.colbert AND r.max_length IS NOT DISTINCT FROM sb.max_length AND r.session = sb.session AND r.no = sb.no""")
def batch_hand_back(spark, d):
    """Every batch answers with its texts' places, one in five fails; members get their slices or the batch's error."""
    members = request_batches_capped(spark, d)
    batch = [*KEYS, "session", "batch_no"]
    ok = F.min("request_id") % 5 != 0
    results = members.groupBy(*batch).agg(ok.alias("ok"), F.sum("n").alias("total")).select(
        *batch, "ok", F.expr("CASE WHEN ok THEN CASE WHEN total > 0 THEN sequence(0L, total - 1) ELSE cast(array() AS array<bigint>) END END").alias("values"), F.expr("CASE WHEN NOT ok THEN 'RuntimeError: encode' END").alias("error"))
    back = R.hand_back(members, results, batch, "request_id")
    return back.select("request_id", "ok", F.when(F.col("ok"), F.size("values").cast("long")).alias("got"), F.expr("CASE WHEN size(values) > 0 THEN values[0] END").alias("first"), "error")


sql_query("latency_metrics", "SELECT event_type, count(*) AS total, round(avg(value), 4) AS mean_s, count(CASE WHEN value > 50 THEN 1 END) AS slow FROM events GROUP BY event_type")
sql_query("prometheus_text",
          r"SELECT array_join(transform(array_sort(collect_list(struct(event_type, n, m))), x -> concat(x.event_type, '_total ', x.n, '\n', x.event_type, '_seconds ', format_string('%.4f', x.m))), '\n') AS body FROM (SELECT event_type, count(*) AS n, round(avg(value), 4) AS m FROM events GROUP BY event_type)",
          "SELECT string_agg(event_type || '_total ' || n || chr(10) || event_type || '_seconds ' || printf('%.4f', m), chr(10) ORDER BY event_type) AS body FROM (SELECT event_type, count(*) AS n, round(avg(value), 4) AS m FROM events GROUP BY event_type)")
sql_query("request_validation", """SELECT DISTINCT request_id, CASE WHEN n_texts < 1 OR n_texts > 128 THEN 'BAD_COUNT' WHEN NOT (dense OR sparse OR colbert) THEN 'NO_OUTPUT' WHEN max_length < 16 OR max_length > 8192 THEN 'BAD_LENGTH' ELSE 'OK' END AS code FROM embed_requests""")
sql_query("channel_projection", "SELECT vec_id, CASE WHEN r.dense THEN v.n END AS dense_dim, r.sparse AS wants_sparse FROM (SELECT vec_id, request_id, CAST(size(dense) AS INT) AS n FROM embed_response) v JOIN (SELECT DISTINCT request_id, dense, sparse FROM embed_requests) r ON r.request_id = v.request_id",
          "SELECT vec_id, CASE WHEN r.dense THEN v.n END AS dense_dim, r.sparse AS wants_sparse FROM (SELECT vec_id, request_id, CAST(len(dense) AS INT) AS n FROM embed_response) v JOIN (SELECT DISTINCT request_id, dense, sparse FROM embed_requests) r ON r.request_id = v.request_id")
