"""Decision tables, folds against plain Python, and interfaces."""
import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import scalars
from foliant.operators import fragments, geometry, layout, models, resilience, retrieval, sinks
from foliant.sources import newest_files, read_env, read_files, read_layout


def test_route_decisions(spark):
    from foliant.plans.routing import route_decision, rule_score

    got = {r.id: r.decision for r in route_decision(spark, "").collect()}
    assert got == {"base": "vlm", "good": "ocr", "medium": "hybrid", "complex": "vlm", "router": "vlm", "texty": "ocr", "photo": "vlm", "screen": "ocr"}
    assert {r.id: r.score for r in rule_score(spark, "").collect()}["texty"] == -4


def test_error_classes(spark):
    from foliant.plans.resilience import error_class

    got = [r["class"] for r in error_class(spark, "").orderBy("id").collect()]
    assert got == ["SAFE", "UNKNOWN", "UNKNOWN", "SAFE", "UNKNOWN", "SAFE", "UNKNOWN", "NO", "NO", "SAFE", "UNKNOWN", "SAFE", "SAFE", "UNKNOWN", "UNKNOWN", "UNKNOWN", "SAFE"]


def captions_one_by_one(elements):
    """The rule read element by element; waits: (caption, is it a figure's, has it found one)."""
    out, waits = [], None

    def end():
        nonlocal waits
        if waits and not waits[2]:
            out.append(["paragraph", waits[0][2], waits[0][3], None])
        waits = None

    for e in elements:
        _, kind, text, page, y0 = e
        if kind == "caption":
            end()
            if text.startswith("图") and out and out[-1][0] == "figure" and out[-1][3] is None:
                out[-1][3] = text
            else:
                waits = [e, text.startswith("图"), False]
            continue
        row = [kind, text, page, None]
        if waits and not waits[1]:
            if kind in ("table", "figure"):
                row[3], waits = waits[0][2], None
            else:
                end()
        elif waits and kind == "table":
            end()
        elif waits and kind == "figure":
            c = waits[0]
            if (page == c[3] and y0 >= c[4] - 1) or page == c[3] + 1:
                row[3], waits[2] = c[2], True
        out.append(row)
    end()
    return [tuple(r) for r in out]


def test_captions(spark):
    rng, rows, want = random.Random(1), [], {}
    docs = {d: [] for d in range(300)}
    for d in docs:
        page = 1
        for i in range(rng.randint(1, 14)):
            page += rng.random() < 0.25
            kind = rng.choice(["caption", "caption", "figure", "figure", "table", "paragraph"])
            docs[d].append((i, kind, rng.choice(["图 1", "图2 x", "表 3", "表4"]) if kind == "caption" else kind, page, float(rng.randint(0, 6))))
    docs[900] = [(1, "caption", "图 4 曲线", 1, 10.0), (2, "figure", "f", 1, 20.0), (3, "paragraph", "A) x", 1, 40.0), (4, "figure", "g", 2, 5.0), (5, "table", "t", 2, 50.0)]
    for d, v in docs.items():
        rows += [(d, *e) for e in v]
        want[d] = captions_one_by_one(v)
    got = {}
    df = spark.createDataFrame(rows, "doc_id int, seq int, kind string, text string, page int, y0 double").withColumn("win", F.lit("clash"))
    for r in geometry.attach_captions(df, "doc_id").orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.text, r.page, r.caption))
    assert got == want and [r[3] for r in got[900]] == ["图 4 曲线", None, "图 4 曲线", None]
    assert geometry.attach_captions(df.limit(0), "doc_id").count() == 0


def test_table_fragments(spark):
    t = lambda d, seq, page, *rows: (d, seq, "table", page, page, [list(r) for r in rows])
    rows = [
        ("a", 1, "caption", 1, 1, None), t("a", 2, 1, ["h1", "h2"], ["1", "2"]), t("a", 3, 2, ["h1", "h2", "h3", "h4", "h5"]), t("a", 4, 3, ["h1", "h2"], ["3", "4"]),
        t("b", 1, 1, ["x"], ["y"]), t("b", 2, 2, ["x"]), ("b", 3, "paragraph", 2, 2, None), t("b", 4, 2, ["x"]), t("b", 5, 4, ["x"]), ("c", 1, "table", 1, 1, None), t("c", 2, 1, [None, " q\n"]), t("c", 3, 1, ["", "q"], ["r", None]),
    ]
    df = spark.createDataFrame(rows, "doc_id string, seq int, kind string, page int, page_end int, rows array<array<string>>").withColumn("run", F.lit("clash"))
    got = [tuple(r) for r in fragments.merge_tables(df, "doc_id").orderBy("doc_id", "pos").collect()]
    # below a caption fragments of other widths go on as long as there are three rows at most
    assert got == [("a", 0, "caption", 1, 1, 0, 1), ("a", 1, "table", 1, 3, 4, 3), ("b", 0, "table", 1, 2, 2, 1), ("b", 1, "paragraph", 2, 2, 0, 1), ("b", 2, "table", 2, 2, 1, 1),
                   ("b", 3, "table", 4, 4, 1, 1), ("c", 0, "table", 1, 1, 0, 1), ("c", 1, "table", 1, 1, 2, 2)]
    assert fragments.merge_tables(df.limit(0), "doc_id").count() == 0


def test_longest_prefix_keeps_repeated_rows(spark):
    items = spark.createDataFrame([("my_api_x",), ("my_api_x",), ("z",), (None,)], "name string")
    got = retrieval.longest_prefix(items, "name", spark.createDataFrame([("my",), ("my_api",), ("my",)], "server string"), "server").collect()
    assert sorted((str(r.name), str(r.server)) for r in got) == [("None", "None"), ("my_api_x", "my_api"), ("my_api_x", "my_api"), ("z", "None")]


def plain_pack(lengths, limit):
    out, acc, no = [], 0, 0
    for n in lengths:
        if acc + n > limit and acc > 0:
            acc, no = 0, no + 1
        acc += n
        out.append(no)
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 700), min_size=1, max_size=30))
def test_pack_fold(spark, lengths):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(lengths)], "doc_id int, seq int, text string")
    got = [r.chunk_no for r in layout.pack(df, ["doc_id"]).orderBy("seq").collect()]
    assert got == plain_pack(lengths, 600)


def test_pack_fixture(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([300, 200, 200, 600, 50])], "doc_id int, seq int, text string")
    assert [r.chunk_no for r in layout.pack(df, ["doc_id"]).orderBy("seq").collect()] == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("text,kind", [("【药品名称】", "heading"), ("表 1：", "caption"), ("x" * 30, "subheading"), ("x" * 31 + "=", "paragraph"), ("x" * 50, "subheading"), ("x" * 51, "paragraph"), ("短句。", "paragraph"), ("*" + "x" * 40, "paragraph")])
def test_kinds(spark, text, kind):
    assert spark.range(1).select(layout.element_kind(F.lit(text)).alias("k")).first().k == kind


def breaker_one_by_one(calls, threshold, cool, probe_max):
    state, fails, opened, probes, out = "CLOSED", 0, 0, 0, []
    for t, r in calls:
        if state == "OPEN" and t - opened >= cool:
            state, probes = "HALF_OPEN", probe_max
        if state == "OPEN" or (state == "HALF_OPEN" and probes == 0):
            out.append((state, False))
            continue
        if state == "HALF_OPEN":
            probes -= 1
        if r == "ok":
            state, fails = "CLOSED", 0
        elif r == "down" and state == "HALF_OPEN":
            state, opened = "OPEN", t
        elif r == "down":
            fails += 1
            if fails >= threshold:
                state, opened = "OPEN", t
        out.append((state, True))
    return out


@pytest.mark.parametrize("probe_max", [1, 2])
def test_breaker(spark, probe_max):
    rng, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    fixed = [(0, "down"), (1, "down"), (2, "ok"), (4000, "down"), (4001, "ok"), (9000, "ok"), (9001, "down"), (9002, "business"), (9003, "down"), (20000, "business"), (20001, "ok"), (90000, "ok")]
    tools = {0: fixed} | {k: sorted((rng.randrange(60_000), rng.choice(["ok", "ok", "ok", "down", "down", "business"])) for _ in range(120)) for k in range(1, 25)}
    tools |= {k: sorted((rng.randrange(3_000_000), rng.choice(["ok", "ok", "down"])) for _ in range(120)) for k in range(25, 40)}
    rows = [(k, i, t0 + dt.timedelta(seconds=t), r) for k, v in tools.items() for i, (t, r) in enumerate(v)]
    df = spark.createDataFrame(rows, "tool int, id int, ts timestamp, result string")
    got = {}
    for r in resilience.breaker(df, "tool", "ts", "id", "result", probe_max=probe_max).orderBy("tool", "seq").collect():
        got.setdefault(r.tool, []).append((r.state, r.admitted))
    assert got == {k: breaker_one_by_one(v, 2, 3600, probe_max) for k, v in tools.items()}
    assert {s for v in got.values() for s, _ in v} == {"CLOSED", "OPEN", "HALF_OPEN"}
    assert resilience.breaker(df.limit(0), "tool", "ts", "id", "result").count() == 0


def test_batcher_target(spark):
    df = spark.createDataFrame([("k", i, a, n) for i, (a, n) in enumerate([(0, 20), (1, 20), (2, 5), (100, 100), (101, 1)])], "k string, id int, a long, n int")
    got = {r.id: (r.session, r.batch_no) for r in resilience.capped_batches(df, ["k"], "a", "n", "id", 4, 32).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 1), 3: (2, 0), 4: (2, 1)}
    alone = {r.id: (r.session, r.batch_no) for r in resilience.capped_batches(df, ["k"], "a", "n", "id", 4, 0).collect()}
    assert alone == {0: (1, 0), 1: (1, 1), 2: (1, 2), 3: (2, 0), 4: (2, 1)}


def test_batch_call_isolates(spark):
    calls = spark.createDataFrame([(i, p) for i, p in enumerate(["a.png", "bad.png", "c.png"])], "id int, path string")

    def model(v):
        if any("bad" in x for x in v):
            raise ValueError("cannot read image")
        return [x.upper() for x in v]

    got = {r.id: (r.ok, r.data, r.error) for r in models.batch_call(calls.coalesce(1), "id", "path", model).collect()}
    assert got == {0: (True, "A.PNG", None), 1: (False, None, "ValueError: cannot read image"), 2: (True, "C.PNG", None)}


def test_calls():
    import time

    from foliant.operators.calls import Policy, call, failure_class

    class NetworkError(Exception):
        pass

    slept = []

    def failing(*errors):
        left = list(errors)

        def f():
            if left:
                raise left.pop(0)
            return 7

        return f

    r = call(failing(ConnectionError("a"), TimeoutError("b")), sleep=slept.append)
    assert (r.ok, r.data, r.attempts, slept) == (True, 7, 3, [1.0, 2.0])
    r = call(failing(*[NetworkError("x")] * 9), policy=Policy(idempotent=False), sleep=slept.append)
    assert (r.ok, r.attempts, r.blocked, r.waited_s) == (False, 4, False, 3.0) and "called 4 times" in r.error
    r = call(failing(ConnectionResetError()), policy=Policy(idempotent=False), sleep=slept.append)
    assert (r.attempts, r.blocked, r.klass) == (1, True, "UNKNOWN")
    r = call(failing(ConnectionError(), TimeoutError()), policy=Policy(idempotent=False), sleep=slept.append)
    assert (r.attempts, r.blocked, r.klass) == (2, False, "UNKNOWN")
    r = call(failing(ValueError("no")), sleep=slept.append)
    assert (r.ok, r.attempts, r.klass, r.error) == (False, 1, "NO", "ValueError: no")
    r = call(time.sleep, 5, policy=Policy(attempts=2, base_s=0.0, timeout_s=0.05))
    assert (r.ok, r.attempts, r.klass) == (False, 2, "UNKNOWN")
    assert [failure_class(e) for e in (NetworkError(), OSError("timed out"), KeyError())] == ["SAFE", "UNKNOWN", "NO"]


def test_batch_call_retries_what_passes(spark):
    calls = spark.createDataFrame([(i, f"{i}.png") for i in range(5)], "id int, path string").coalesce(1)
    seen = []

    def model(v):
        seen.append(len(v))
        if len(seen) < 3:
            raise ConnectionError("down")
        return [x.upper() for x in v]

    got = models.batch_call(calls, "id", "path", model, policy=models.Policy(attempts=3, base_s=0.0)).collect()
    assert all(r.ok and r.data == f"{r.id}.PNG" for r in got) and len(got) == 5


def test_build_chunks(spark):
    rows = [(1, i, s, k, k2, "x" * n, p) for i, (s, k, k2, n, p) in enumerate([
        (1, "A", "subheading", 10, 1), (1, "A", "paragraph", 580, 1), (1, "A", "paragraph", 20, 2), (1, "A", "table", 700, 2), (1, "A", "paragraph", 5, 3), (1, "A", "subheading", 8, 3), (1, "A", "paragraph", 9, 4),
        (2, "B", "paragraph", 5, 4), (2, "B", "figure", 3, 5), (2, "B", "table", 3, 5), (2, "B", "paragraph", 900, 6),
    ])]
    df = spark.createDataFrame(rows, "doc int, seq int, section_no int, section string, kind string, text string, page int").withColumn("island", F.lit("clash"))
    got = [(r.id, r.type, r.section, r.sub_section and len(r.sub_section), r.char_len, r.page_start, r.page_end, r.block_id) for r in layout.build_chunks(df, "doc").orderBy("id").collect()]
    assert got == [
        ("c001", "text", "A", 10, 591, 1, 1, None), ("c002", "text", "A", 10, 20, 2, 2, None), ("c003", "table", "A", 10, 700, 2, 2, "table-01"), ("c004", "text", "A", 10, 5, 3, 3, None), ("c005", "text", "A", 8, 18, 3, 4, None),
        ("c006", "text", "B", None, 5, 4, 4, None), ("c007", "figure", "B", None, 3, 5, 5, "figure-01"), ("c008", "table", "B", None, 3, 5, 5, "table-02"), ("c009", "text", "B", None, 900, 6, 6, None),
    ]
    assert layout.build_chunks(df.limit(0), "doc").count() == 0


def test_overlap(spark):
    from foliant.plans.joins import bbox_overlap_antijoin

    assert {r.seq for r in bbox_overlap_antijoin(spark, "").collect()} == {2, 3, 4, 5}
    assert geometry.overlap_ratio("a", "b") is not None


@pytest.mark.parametrize("text,value", [("2+3*4", "14"), ("-7//2", "-4"), ("2**1000", "error: ValueError"), ("a", "error: ValueError"), ("(1", "error: SyntaxError"), ("-2**2", "-4"), ("2**3**2", "512"), ("2**-1", "0.5"), ("1 2", "error: SyntaxError"), ("(" * 5000, "error: ValueError"), ("1e3+.5", "1000.5"), (None, None)])
def test_calculator(text, value):
    assert scalars.evaluate(text) == value


def test_dense_empty_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id int, v array<double>")
    q = v.filter("id = 1").withColumnRenamed("id", "qid")
    assert [(r.id, r.rank) for r in retrieval.dense_top(q, v, "qid", "id", "v", k=2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert retrieval.dense_top(q.limit(0), v, "qid", "id", "v").count() == 0
    assert retrieval.dense_top(q, v.limit(0), "qid", "id", "v").count() == 0


def test_cache(spark, tmp_path):
    rows = [("a", "v1", "1", None, dt.datetime(2024, 1, 1)), ("a", "v1", "2", None, dt.datetime(2024, 1, 2)), ("b", "v1", "3", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)), ("a", "v2", "4", None, dt.datetime(2024, 1, 3))]
    sinks.put_cache(spark, str(tmp_path / "c"), spark.createDataFrame(rows, "key string, version string, value string, expire_at timestamp, written_at timestamp"))
    got = {r.key: r.value for r in sinks.get_cache(spark, str(tmp_path / "c"), "v1", F.lit(dt.datetime(2024, 6, 1))).collect()}
    assert got == {"a": "2"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "layout.json").write_text('{"meta": {"doc_id": "D1"}, "chunks": [{"id": "c001", "type": "text", "content": "x", "extra": 1}], "other": 2}')
    got = read_layout(spark, str(tmp_path / "layout.json")).collect()
    assert got[0].doc_id == "D1" and got[0].id == "c001" and got[0].section is None
    (tmp_path / ".env").write_text("# c\nA=1\nplain\nB=\"x=y\"\n")
    assert {r.key: r.value for r in read_env(spark, str(tmp_path / ".env")).collect()} == {"A": "1", "B": "x=y"}
    files = tmp_path / "f"
    files.mkdir()
    (files / "a_content_list.json").write_text("[]")
    (files / "big.bin").write_bytes(b"x" * 100)
    assert newest_files(spark, str(files), "*_content_list.json").first().stem == "a"
    ok, no = read_files(spark, str(files), 50)
    assert ok.count() == 1 and no.count() == 1
    sinks.write_figures(spark.createDataFrame([("figure-01", "png", bytearray(b"abc")), ("figure-02", "png", None)], "id string, ext string, image binary"), str(tmp_path / "fig"))
    assert (tmp_path / "fig" / "figure-01.png").read_bytes() == b"abc" and not (tmp_path / "fig" / "figure-02.png").exists()
    sinks.append_rounds(spark.createDataFrame([(1, "q")], "n int, q string"), str(tmp_path / "log"))
    sinks.append_rounds(spark.createDataFrame([(2, "r")], "n int, q string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_tables(spark.createDataFrame([("table-01", "cap", "| a |")], "id string, caption string, md string"), str(tmp_path / "tab"))
    with pytest.raises(FileNotFoundError):
        sinks.read_vectors(spark, str(tmp_path / "none"))


def test_registry(spark):
    from foliant.operators.tools import Registry, Tool, attempts_allowed, reflect_loop, resolve_engine

    def divide(a, b):
        return a / b

    reg = Registry([Tool("divide", divide, {"a": "number", "b": "number"}, ("a", "b")), Tool("charge", lambda: 1, idempotent=False)])
    calls = spark.createDataFrame([(1, "divide", '{"a": 6, "b": 3}'), (2, "divide", '{"a": 6'), (3, "nosuch", "{}"), (4, "divide", '{"a": "x", "b": 1}'), (5, "divide", '{"a": 1, "b": 0}'), (6, "charge", "{}"), (7, "divide", None)], "id int, name string, args string")
    got = {r.id: (r.code, r.result) for r in reg.calls(calls, "id", "name", "args").collect()}
    assert got == {1: (None, "2.0"), 2: ("INVALID_JSON", None), 3: ("UNKNOWN_TOOL", None), 4: ("VALIDATION_ERROR", None), 5: ("EXECUTION_ERROR", None), 6: ("BLOCKED_WRITE", None), 7: ("VALIDATION_ERROR", None)}
    assert reg.catalogue(spark).count() == 2
    assert attempts_allowed(["SAFE"] * 9, True) == (3, False, 3.0) and attempts_allowed(["SAFE"] * 9, False) == (4, False, 3.0)
    assert attempts_allowed(["UNKNOWN"], False) == (1, True, 0.0) and attempts_allowed(["NO"], True) == (1, False, 0.0) and attempts_allowed(["SAFE", None], True) == (2, False, 1.0)
    log = reflect_loop("t", lambda t, f: f + "x", lambda t, a: (len(a) >= 3, a + "!"))
    assert [x[2] for x in log] == [False, True]
    assert resolve_engine("mineru", {"mineru": False, "pymupdf": True}, "pymupdf") == "pymupdf"
    with pytest.raises(LookupError):
        resolve_engine("mineru", {})
