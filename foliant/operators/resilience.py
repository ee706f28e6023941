"""Call logs: error classes, failure runs, circuit breaker, retries, ledgers, request batches."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.folds import ordered_fold


def error_class(status: Column, exc: Column, message: Column | None = None) -> Column:
    """SAFE may be retried, UNKNOWN may have had an effect, NO must not be retried. The status decides if there is one, then
    the kinds of exception that are known, then what name (in any case) and message hint at."""
    name = F.lower(exc)
    late = name.contains("timeout") | F.lower(F.lit("") if message is None else F.coalesce(message, F.lit(""))).contains("timed out")
    return (
        F.when(status.isin(429, 503), "SAFE").when(status == 504, "UNKNOWN").when(status >= 500, "SAFE").when(status.isNotNull(), "NO")
        .when(exc == "ConnectTimeout", "SAFE").when(exc.isin("ConnectionResetError", "BrokenPipeError", "ChunkedEncodingError"), "UNKNOWN").when(late, "UNKNOWN")
        .when(name.rlike("connection|network|dns"), "SAFE").when(name.rlike("reset|broken|chunked"), "UNKNOWN").otherwise("NO")
    )


def backoff(base: Column, attempt: Column) -> Column:
    return base * F.pow(F.lit(2.0), attempt)


def failure_runs(log: DataFrame, key: str, order: list[str], sig: str, failed: str) -> DataFrame:
    """Runs of the same call with the same outcome, by gaps and islands: (key, run, sig, failed, n, first, last)."""
    w = W.partitionBy(key).orderBy(*order)
    change = (~F.col(sig).eqNullSafe(F.lag(sig).over(w))) | (~F.col(failed).eqNullSafe(F.lag(failed).over(w)))
    r = log.withColumn("run", F.sum(change.cast("int")).over(w))
    return r.groupBy(key, "run", sig, failed).agg(F.count("*").alias("n"), F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"))


def outcome(failed: Column, klass: Column) -> Column:
    """ok; down: a failure of what is called, which a breaker counts; business: an answer that says no, which it does not."""
    return F.when(~failed, "ok").when(klass.isin("SAFE", "UNKNOWN"), "down").otherwise("business")


def _carried(x: DataFrame, keys: list[str], bucket: str, sums: list[Column], carry: dict[str, Column]) -> DataFrame:
    """Adds to each row what a small table of one row per key and bucket knows of the buckets before."""
    small = x.groupBy(*keys, bucket).agg(*sums)
    for name, c in carry.items():
        small = small.withColumn(name, c)
    small = small.select(*[F.col(c).alias(f"k_{c}") for c in (*keys, bucket)], *carry)
    on = None
    for c in (*keys, bucket):
        e = F.col(c).eqNullSafe(F.col(f"k_{c}"))
        on = e if on is None else on & e
    return x.join(small, on, "left").drop(*[f"k_{c}" for c in (*keys, bucket)])


def breaker(log: DataFrame, key: str, ts: str, seq: str, result: str, threshold: int = 2, cooldown_s: int = 3600, probe_max: int = 1) -> DataFrame:
    """(key, seq, state, admitted) after each call of a log with ``result`` ok, down or business, in order of time.

    CLOSED opens after ``threshold`` failures (down) in a row; a success takes them back, business answers change nothing.
    OPEN rejects until ``cooldown_s`` is over, then HALF_OPEN admits ``probe_max`` calls: a success closes, a failure
    opens again and starts the time anew; probes that a business answer has used up are not given back, so such a breaker
    stays as it is. Null results count as ok.

    A key may hold most rows: a success that no failure of the last ``cooldown_s`` precedes leaves the breaker closed whatever
    came before (unless its probes were used up), so the rows of a key are cut there and the parts are folded apart;
    if the probes were used up in a part, the later parts of the key are rejected.
    """
    over = W.partitionBy("key_").orderBy("bucket_")
    in_bucket = W.partitionBy("key_", "bucket_").orderBy("us_", "seq_")
    before = in_bucket.rowsBetween(W.unboundedPreceding, -1)
    cool = cooldown_s * 1_000_000
    x = log.select(
        F.col(key).alias("key_"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us_"), F.col(seq).cast("long").alias("seq_"), F.coalesce(F.col(result), F.lit("ok")).alias("r_")
    ).withColumn("bucket_", F.floor(F.col("us_") / (64 * max(cool, 1))))
    down = F.when(F.col("r_") == "down", F.col("us_"))
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    x = _carried(x, ["key_"], "bucket_", [F.max(down).alias("d_")], {"last_": F.max("d_").over(earlier)})
    last = F.coalesce(F.max(down).over(before), F.col("last_"))
    x = x.withColumn("cut_", ((F.col("r_") == "ok") & (last.isNull() | (F.col("us_") - last >= cool))).cast("int"))
    x = x.withColumn("n_", F.coalesce(F.sum("cut_").over(before), F.lit(0)))
    x = _carried(x, ["key_"], "bucket_", [F.sum("cut_").alias("c_")], {"so_far_": F.coalesce(F.sum("c_").over(earlier), F.lit(0))})
    x = x.select("key_", (F.col("n_") + F.col("so_far_")).cast("long").alias("part_"), "us_", "seq_", "r_")

    def start():
        return ("CLOSED", 0, 0, 0)

    def step(s, us, r):
        state, fails, opened, probes = s
        if state == "OPEN" and us - opened >= cool:
            state, probes = "HALF_OPEN", probe_max
        if state == "OPEN" or (state == "HALF_OPEN" and probes <= 0):
            return (state, fails, opened, probes), (state, False, state == "HALF_OPEN")
        probes -= state == "HALF_OPEN"
        if r == "ok":
            state, fails = "CLOSED", 0
        elif r == "down":
            fails += state == "CLOSED"
            if state == "HALF_OPEN" or fails >= threshold:
                state, opened, probes = "OPEN", us, 0
        return (state, fails, opened, probes), (state, True, state == "HALF_OPEN" and probes <= 0)

    y = ordered_fold(x, ["key_", "part_"], ["us_", "seq_"], ["us_", "r_"], start, step, "state_ string, admitted_ boolean, used_ boolean")
    used = y.groupBy("key_").agg(F.min(F.when(F.col("used_"), F.struct("part_", "us_", "seq_"))).alias("first_")).filter("first_ IS NOT NULL").select(F.col("key_").alias("k_"), F.col("first_.part_").alias("stuck_"))
    y = y.join(used, F.col("key_").eqNullSafe(F.col("k_")), "left")
    late = F.coalesce(F.col("part_") > F.col("stuck_"), F.lit(False))
    return y.select(F.col("key_").alias(key), F.col("seq_").alias("seq"), F.when(late, "HALF_OPEN").otherwise(F.col("state_")).alias("state"), (F.col("admitted_") & ~late).alias("admitted"))


def number_sessions(requests: DataFrame, keys: list[str], arrival: str, order: str, grace: int, width: int = 60_000) -> DataFrame:
    """Adds session, from 1 per key: a new one starts where an arrival is more than ``grace`` behind the one before.

    A few keys may hold most rows, so windows run per key and time bucket of ``width``; what crosses a bucket's edge (the
    last arrival before it, the sessions so far) comes from one row per bucket.
    """
    r = requests.withColumn("bucket_", F.floor(F.col(arrival) / width))
    w = W.partitionBy(*keys, "bucket_").orderBy(arrival, order)
    over = W.partitionBy(*keys).orderBy("bucket_")
    edge = r.groupBy(*keys, "bucket_").agg(F.max(arrival).alias("top_")).withColumn("before_", F.lag("top_").over(over)).drop("top_")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "bucket_")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    x = r.alias("l").join(edge.alias("r"), on, "left").select("l.*", "r.before_")
    prev = F.coalesce(F.lag(arrival).over(w), F.col("before_"))
    x = x.withColumn("start_", (prev.isNull() | (F.col(arrival) - prev > grace)).cast("int")).withColumn("in_", F.sum("start_").over(w))
    sums = x.groupBy(*keys, "bucket_").agg(F.sum("start_").alias("n_")).withColumn("so_far_", F.coalesce(F.sum("n_").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    y = x.alias("l").join(sums.alias("r"), on, "left").select("l.*", "r.so_far_")
    return y.withColumn("session", (F.col("so_far_") + F.col("in_")).cast("int")).drop("bucket_", "before_", "start_", "in_", "so_far_")


def gap_batches(requests: DataFrame, keys: list[str], arrival: str, size: str, order: str, grace: int) -> DataFrame:
    """Requests of the same options whose arrivals follow each other within ``grace`` form one batch."""
    r = number_sessions(requests, keys, arrival, order, grace).withColumnRenamed("session", "batch_no")
    return r.groupBy(*keys, "batch_no").agg(F.count("*").alias("n_requests"), F.sum(size).cast("long").alias("n_texts"), F.min(arrival).alias("first_ms"), F.max(arrival).alias("last_ms"))


def capped_batches(requests: DataFrame, keys: list[str], arrival: str, size: str, order: str, grace: int, target: int) -> DataFrame:
    """(keys, session, order, batch_no, place, n): as gap_batches, and a batch also ends with the request that brings it to
    ``target`` texts, which it may pass; so a request of ``target`` texts or more that opens a batch is one by itself, and with
    target 0 every request is. ``place`` is the place of the request's texts in its batch. Null sizes count as 0.

    A session of the gap rule is independent of all others, so the fold runs per session, not per key.
    """
    r = number_sessions(requests, keys, arrival, order, grace).select(*keys, "session", F.col(arrival).alias("a_"), order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n_"))

    def step(state, n):
        no, total, some = state
        if some and total >= target:
            no, total = no + 1, 0
        return (no, total + n, True), (no, total)

    y = ordered_fold(r, [*keys, "session"], ["a_", order], ["n_"], lambda: (0, 0, False), step, "batch_no int, place long")
    return y.select(*keys, "session", order, "batch_no", "place", F.col("n_").alias("n"))


def hand_back(members: DataFrame, results: DataFrame, batch: list[str], order: str) -> DataFrame:
    """(order, ok, values, error): each request's slice of its batch's results; an error of a batch goes to all its members.

    ``members`` as capped_batches gives them, ``results`` (batch, ok, values array, error), one row per batch; a batch without
    a row, or with fewer values than its members ask for, is an error."""
    r = results.select(*[F.col(c).alias(f"b_{c}") for c in batch], F.col("ok").alias("ok_"), F.col("values").alias("values_"), F.col("error").alias("error_"))
    on = None
    for c in batch:
        e = F.col(c).eqNullSafe(F.col(f"b_{c}"))
        on = e if on is None else on & e
    whole = F.coalesce(F.col("ok_") & (F.size("values_") >= F.col("place") + F.col("n")), F.lit(False))
    return members.join(r, on, "left").select(
        order, whole.alias("ok"), F.when(whole, F.slice("values_", (F.col("place") + 1).cast("int"), F.col("n").cast("int"))).alias("values"),
        F.when(~whole, F.coalesce("error_", F.when(F.col("ok_"), "too few results").otherwise("no result"))).alias("error"),
    )
