"""Queries that run as streams over what is there."""
from __future__ import annotations

from foliant.registry import query
from foliant.streaming import jobs as J


@query("stream_batches", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM s), g AS (SELECT user_id, no, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n FROM b GROUP BY user_id, no)
 SELECT user_id, start::VARCHAR AS start, n FROM g WHERE e <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_batches(spark, d):
    """Sessions that the watermark has closed."""
    out = J.run_once(J.session_batches(J.event_stream(spark, d), "user_id"))
    return out.selectExpr("user_id", "CAST(start AS STRING) AS start", "n")


@query("stream_dedupe", "SELECT event_id FROM events")
def stream_dedupe(spark, d):
    """Every event once, whatever is sent again."""
    e = J.event_stream(spark, d)
    return J.run_once(J.first_writes(e.union(e), ["event_id"])).select("event_id")
