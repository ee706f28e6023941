"""Operators of the llm subpackage on small fixtures: brute force, round trips, defined results of odd inputs."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import lookalikes, neardup, neighbors, packing, pii, scans, splitting, tokens
from tests.harness import SF

VOCAB = tokens.DEFAULT_VOCAB


# ---- 1 -------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reader():
    base = "the dose should be halved because the mean half-life of patients remained unchanged and palpitations were reported".split()
    words = {w: 500 for w in base} | {"120": 300, "12": 300}
    text = "患者应口服本品，患者血压应复查。"
    a, _ = scans._codes(["", text, ""])
    t, _ = scans._triples(a)
    u, n = np.unique(t, return_counts=True)
    none = np.zeros(0, np.int64)
    return scans.Reader(words, u, n * 200, none, none, {"tablets"}, ["foobar"], ["# @", "@ package leaflet", "@ 产 品 说 明 书 #"])


@pytest.mark.parametrize("line,kind", [
    ("- 4 -", True), ("第 2 页 共 9 页", True), ("Pagc 11 of 20", True), ("5/17", True), ("xxii", True), ("Seite 21 v0n 32", True), ("[22]", True), ("within 7 hours", False), ("57.4%.", False), ("", False), ("leaflet 12", False),
])
def test_page_numbers(line, kind):
    assert scans.page_number(line) == kind


@pytest.mark.parametrize("line,kind", [
    ("YBSM2113795  Foobar", True), ("Foobar 产品说明书 YBSM2212861", True), ("12   Foobar package leaflet", True), ("Foobar packagc lcaflet", True), ("F00bar package leaflet  3", True), ("Unknownamol package leaflet", True),
    ("F o o b a r   p a c k a g e   l e a f l e t", True), ("the dose should be halved", False), ("foobar was reported", False),
])
def test_headers_by_learned_forms(reader, line, kind):
    s = scans.plain_line(line)
    signs = reader.signs_of(s)
    assert bool(signs and reader.header(s, signs)) == kind


def test_unseen_header_is_learned(spark):
    body = ["the dose was halved after {} days of", "treatment and the patients remained in bed", "until plasma values had returned to baseline"]
    rows = [("chunks", i, f"{body[0].format(i)}\nSummary of product characteristics Foobar {i}\n{body[1]} {i}\n{body[2]} {i} days.") for i in range(20)]
    rows += [("chunks", 100 + i, f"in {i} cases treatment and the patients remained in bed until plasma values had returned, the summary of events was short") for i in range(30)]
    df = spark.createDataFrame(rows, "src string, row_key long, text string")
    counts = scans.corpus_counts(df, "text")
    assert scans.header_forms(df, ["foobar"], counts) == ["summary of product characteristics @"]
    shared = spark.sparkContext.broadcast((*counts, set(), ["foobar"], scans.header_forms(df, ["foobar"], counts)))
    got = {(r.row_key, r.line_no) for r in scans.find_noise(df, shared).filter("noise = 'header'").collect()}
    assert got == {(i, 1) for i in range(20)}
    assert scans.header_forms(df.limit(0), [], scans.corpus_counts(df.limit(0), "text")) == []


def test_examine(reader):
    text = "the d0se should be hal-\nved because the mean half-\nlife of palpi-\n\n- 4 -\n\ntations remained unchanged"
    noise, fixed = scans.examine(text, reader)
    assert noise == [(0, "char"), (0, "hyphen"), (2, "hyphen"), (4, "page_no")]
    assert fixed == "the dose should be halved because the mean half-life of palpitations remained unchanged"
    noise, fixed = scans.examine("惠者应口服本品，患者血压庆复查。", reader)
    assert noise == [(0, "char")] and fixed == "患者应口服本品，患者血压应复查。"
    assert scans.examine("", reader) == ([], "")
    assert scans.examine("l20 tablets shoiild be halved", reader)[1] == "120 tablets should be halved"


def edits(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_automaton_against_brute_force(most):
    rng = random.Random(1)
    vocabulary = {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(300)}
    queries = ["".join(rng.choice("abcdéx") for _ in range(rng.randint(0, 8))) for _ in range(300)] + ["", "a" * 70]
    for q, found in zip(queries, scans.Trie(vocabulary).within(queries, most)):
        assert sorted(found) == sorted((w, edits(q, w)) for w in vocabulary if edits(q, w) <= most)
    assert scans.Trie([]).within(["a"], 2) == [[]]


def test_candidates_are_ranked_by_neighbours():
    words = {"take": 400, "one": 400, "dose": 300, "doze": 300, "daily": 400, "patient": 500}
    pairs = {("one", "dose"): 200, ("dose", "daily"): 200, ("the", "doze"): 100}
    code = {scans.pair_code(scans.word_hash(a), scans.word_hash(b)): n for (a, b), n in pairs.items()}
    k = np.array(sorted(code), np.int64)
    none = np.zeros(0, np.int64)
    r = scans.Reader(words, none, none, k, np.array([code[int(x)] for x in k]), set())
    assert r.word("doxe", "one", "daily")[0] == "dose"  # no confusion explains it: the neighbours do
    assert r.word("doxe", "a", "b") is None and r.word("ptaient", None, None) is None
    assert r.word("patlent", None, None) == ("patient", 3)


def test_copies_of_a_misread_text_count_once(spark):
    right = [f"the dose should be halved in group {chr(97 + i // 26)}{chr(97 + i % 26)}， 患者血压应复查并且应口服本品{chr(0x4E00 + i)}。" for i in range(300)]
    wrong = ["remain in bed, the d0se shou1d be halved", "本组患者血压庆复查并且应口服本品。"]
    copies = [(w,) for w in wrong for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in right] + copies, "t string")
    shared = spark.sparkContext.broadcast((*scans.corpus_counts(df, "t"), set()))
    looked = spark.createDataFrame([("chunks", i, w) for i, w in enumerate(wrong)], "src string, row_key long, text string")
    assert {(r.row_key, r.noise) for r in scans.find_noise(looked, shared).collect()} == {(0, "char"), (1, "char")}
    assert [r.repaired for r in scans.repair(looked, shared).orderBy("row_key").collect()] == ["remain in bed, the dose should be halved", "本组患者血压应复查并且应口服本品。"]


def test_counts_are_whole(spark, monkeypatch):
    for bound in ("MAX_WORDS", "MAX_PAIRS", "MAX_TRIPLES", "MAX_FORMS", "PART", "MEMO"):
        monkeypatch.setattr(scans, bound, 3, raising=False)
    rng = random.Random(3)
    stems = ["Dose", "dosis", "tablet", "hälfte", "patient", "120mg", "plasma", "levél"]
    texts = ["患者应口服本品，" + "".join(rng.choice("患者血压应复查痛疼") for _ in range(12)) + " " + " ".join(rng.choice(stems) for _ in range(9)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:50]], "t string").repartition(7)
    words, pairs, triples = {}, {}, {}
    for t in set(texts):
        found = [w.lower() for w in scans.WORD.findall(t)]
        for w in found:
            words[w] = words.get(w, 0) + 1
        for x in map(scans.pair_code, map(scans.word_hash, found), map(scans.word_hash, found[1:])):
            pairs[x] = pairs.get(x, 0) + 1
        for x in scans._triples(scans._codes(["", t, ""])[0])[0].tolist():
            triples[x] = triples.get(x, 0) + 1
    counts = scans.corpus_counts(df, "t")
    assert {w: counts[0].get(w) for w in words} == words and counts[0].get("absent") == 0
    for expected, code, n in ((triples, *counts[1:3]), (pairs, *counts[3:])):
        assert list(zip(np.asarray(code).tolist(), np.asarray(n).tolist())) == sorted((c, k) for c, k in expected.items() if k > 1)
    known = {"Ulcus", "dose"}
    a, b = scans.Reader(*counts, known), scans.Reader(words, *map(np.asarray, counts[1:]), known)
    assert a.most == b.most and a.confused == b.confused and (a.pair == b.pair).all() and (a.pair_n == b.pair_n).all() and (a.pair_c == b.pair_c).all()
    best = {}
    for c, n in sorted(triples.items(), key=lambda x: (-x[1], x[0])):
        best.setdefault((c >> 42) << 21 | (c & 0x1FFFFF), (n, c >> 21 & 0x1FFFFF))
    assert all(best[p] == (n, c) for p, n, c in zip(a.pair.tolist(), a.pair_n.tolist(), a.pair_c.tolist()))
    asked = ["d0se", "doses", "ulcu5", "tablct", "plasm", "halfte", "x" * 70]
    assert a.within(asked, 2) == b.within(asked, 2) and a.within(asked, 2)[2] == [("ulcus", 1)]


def test_rare_words_are_counted_at_any_size(spark, monkeypatch):
    for bound in ("MAX_WORDS", "MAX_PAIRS", "MAX_TRIPLES"):
        monkeypatch.setattr(scans, bound, 3, raising=False)
    more = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ara", "olo", "emi")]
    right = [f"{' '.join(more)} the dose should be halved {chr(97 + i // 26)}{chr(97 + i % 26)}， 患者血压应复查并且应口服本品{chr(0x4E00 + i)}。" for i in range(300)]
    df = spark.createDataFrame([(t,) for t in right], "t string")
    shared = spark.sparkContext.broadcast((*scans.corpus_counts(df, "t"), set()))
    looked = spark.createDataFrame([("chunks", 0, "remain in bed, the d0se shou1d be halved"), ("chunks", 1, "本组患者血压庆复查并且应口服本品。")], "src string, row_key long, text string")
    assert {(r.row_key, r.noise) for r in scans.find_noise(looked, shared).collect()} == {(0, "char"), (1, "char")}


def test_texts_examined_together_as_each_alone(reader, monkeypatch):
    parts = ["the d0se should be hal-", "ved because the mean half-", "life of palpi-", "- 4 -", "tations remained unchanged", "惠者应口服本品，患者血压庆复查。", "YBSM2113795  Foobar", "l20 tablets shoiild", "", "CODE1-AB2CD 应口", "血压庆"]
    rng = random.Random(7)
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(60)]
    alone = [scans.examine(t, reader) for t in texts]
    calls = []
    monkeypatch.setattr(reader, "_misread", lambda *x, f=reader._misread: calls.append(1) or f(*x))
    for together in (1000, 7):
        monkeypatch.setattr(scans, "TOGETHER", together)
        calls.clear()
        assert list(scans.examine_all(texts, reader)) == alone
        assert len(calls) <= 3 * -(-len(texts) // together)  # not for each text


def test_scan_tables(spark):
    found = scans.p1_found(spark, SF)
    assert found.columns == ["src", "row_key", "line_no", "noise"]
    rows = found.collect()
    assert len(rows) == len(set(rows)) and {r.noise for r in rows} <= {"hyphen", "char", "header", "page_no"} and len(rows) > 20


# ---- 2 -------------------------------------------------------------------------------------------
def test_neighbors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 64)).astype(np.float32)
    x[300:320] = x[0] + 0.05 * rng.standard_normal((20, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600, rows[5][1]), (601, (2 * x[5]).tolist()), (602, None), (603, []), (604, [1.0]), (605, [0.0] * 64), (606, [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, dense array<float>").withColumn("digest", F.lit(1)).withColumn("block", F.lit(2))
    got = {(r.vec_id, r.neighbor): r.similarity for r in neighbors.nearest(df, "vec_id", "dense", k=10, probes=None).collect()}
    usable = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(v).all() and any(v)]
    ids = np.array([i for i, _ in usable])
    u = np.stack([v / np.linalg.norm(v) for _, v in usable])
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(int(ids[q]), int(ids[j])) for q in range(len(ids)) for j in np.argsort(-s[q], kind="stable")[:10]}
    assert len(want & set(got)) >= 0.97 * len(want)
    assert got[(5, 600)] == pytest.approx(1.0, abs=1e-5) and all(a != b for a, b in got)
    assert max(np.bincount([a for a, _ in got])) == 10
    near = {(r.vec_id, r.neighbor) for r in neighbors.nearest(df, "vec_id", "dense", k=10, probes=4, min_sim=0.9).filter("similarity >= 0.9").collect()}
    assert {(300, 301), (600, 5), (601, 600)} & near and all(s[list(ids).index(a)][list(ids).index(b)] > 0.8999 for a, b in near)


def test_neighbors_empty(spark):
    assert neighbors.nearest(spark.createDataFrame([], "vec_id long, dense array<float>"), "vec_id", "dense").count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64), (2, None)], "vec_id long, dense array<float>")
    assert neighbors.nearest(one, "vec_id", "dense").count() == 0


# ---- 3 -------------------------------------------------------------------------------------------
def boundaries(t):
    return re.split(r"\n|(?<=[。！？；])|(?<=[.!?])(?= )", t)


def test_splitting(spark):
    rng = random.Random(3)
    words = ["alpha", "be.", "c! ", "句子。", "；", "\n", "x" * 90, " ", "d?", "长" * 40]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(20, 120))) for _ in range(60)]
    texts += ["a" * 1500, " " * 700, "b" * 600, "c" * 601, "", None, ("字" * 599 + "。") * 3, "\n" * 650, "e" * 598 + " " * 20 + "\n" + "f" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, content string").withColumn("raw_", F.lit(1)).withColumn("text_", F.lit("x"))
    pieces = splitting.split_oversized(df, "k", "content").orderBy("k", "piece_no").collect()
    by = {}
    for p in pieces:
        by.setdefault(p.k, []).append(p)
    for k, t in enumerate(texts):
        if t is None or len(t) <= 600:
            assert k not in by
            continue
        end = 0
        for p in by.get(k, []):
            assert len(p.piece) <= 600 and 0 <= p.overlap <= 60 and t[p.start_pos : p.end_pos] == p.piece
            assert not t[end : p.start_pos + p.overlap].strip()
            end = p.end_pos
        assert not t[end:].strip()
    cut = {r.k: r["cut"] for r in splitting.cut_kind(df, "k", "content").collect()}
    for k, t in enumerate(texts):
        if t and len(t) > 600 and t.strip():
            assert cut[k] == ("forced" if any(len(x.strip()) > 600 for x in boundaries(t)) else "natural"), k


# ---- 4 -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("method", ["minhash", "prefix"])
def test_near_duplicates(spark, method):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghijklmnop 药品说明书") for _ in range(400)) for _ in range(30)]
    rows = []
    for i, b in enumerate(base):
        rows.append((10 * i, b))
        for j in range(1, 5):
            t = list(b)
            for _ in range(rng.choice([0, 3, 8, 14, 25])):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            rows.append((10 * i + j, "".join(t)))
    rows += [(9000, None), (9001, "short"), (9002, "a" * 300), (9003, "a" * 300), (9004, "")]
    df = spark.createDataFrame(rows, "chunk_key long, content string").withColumn("digest", F.lit(1)).withColumn("key", F.lit(2))
    members, links = neardup.similar_texts(df, "chunk_key", "content", method=method)
    text = dict(rows)
    digest = {r.key: r.digest for r in members.collect()}
    got = {(r.a, r.b) for r in links.collect()}
    keys = [k for k, t in rows if t and len(t) >= 200]
    want = {tuple(sorted((digest[a], digest[b]))) for a in keys for b in keys if digest[a] != digest[b] and neardup.jaccard(text[a], text[b]) >= 0.8}
    assert got == want and digest[9002] == digest[9003] and 9001 not in digest


@pytest.mark.parametrize("rare", [0, 2, 1000])
def test_class_prefixes_lose_no_pair(rare):
    rng = random.Random(1)
    texts = []
    for _ in range(25):
        b = "".join(rng.choice("abcdefghijklm 药品说明书") for _ in range(rng.randint(220, 560)))
        texts.append(b)
        for e in (2, 5, 9, 12):
            t = list(b)
            for _ in range(e):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t) + "qwertz" * rng.randint(0, 6))
    frequency = np.zeros(neardup.BUCKETS, np.int32)
    for t in texts:
        frequency[(np.unique(neardup.hashed_tokens([t])[0]) & np.uint64(neardup.BUCKETS - 1)).astype(int)] += 1
    sig, of = neardup.class_prefixes(texts, frequency, rare=rare)
    held = [set(sig[of == i].tolist()) for i in range(len(texts))]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.jaccard(texts[i], texts[j]) >= 0.8]
    assert len(alike) > 50 and all(held[i] & held[j] for i, j in alike)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 4), (4, 5), (5, 6)], "a long, b long")
    assert {r.node: r.class_id for r in neardup.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7}
    assert neardup.components(links.limit(0)).count() == 0


def test_near_duplicates_empty(spark):
    members, links = neardup.similar_texts(spark.createDataFrame([], "chunk_key long, content string"), "chunk_key", "content")
    assert members.count() == 0 and links.count() == 0


def test_near_texts_of_few_tokens(spark):
    rows = []
    for i in range(500):  # cycles of 12 characters; three more characters behind them: 12 of 15 tokens are shared
        c = "".join(chr(0x4E00 + 15 * i + k) for k in range(12))
        rows += [(2 * i, c * 20), (2 * i + 1, c * 20 + "".join(chr(0x4E00 + 15 * i + k) for k in range(12, 15)))]
    df = spark.createDataFrame(rows, "key long, text string")
    members, links = neardup.similar_texts(df, "key", "text")
    key = {r.digest: r.key for r in members.collect()}
    assert {tuple(sorted((key[r.a], key[r.b]))) for r in links.collect()} == {(2 * i, 2 * i + 1) for i in range(500)}


# ---- 5 -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("a,b", [("Ａ１％", "A1%"), ("é", "é"), ("e​́", "é"), ("a b", "a b"), ("ﬁ", "fi"), ("Cіtу", "City"), ("⼀⽚", "一片"), ("不", "不"), ("ё", "ë"), ("x­⁠︀y", "xy"), ("ΑΒ", "AB")])
def test_same_look(a, b):
    assert lookalikes.normalize(a) == lookalikes.normalize(b) == b


@pytest.mark.parametrize("a,b", [("A", "a"), ("10⁹", "109"), ("m²", "m2"), ("a b", "ab"), ("a  b", "a b"), ("α", "a"), ("é", "e"), ("间", "问"), ("–", "-"), ("a\nb", "a b")])
def test_other_look(a, b):
    assert lookalikes.normalize(a) != lookalikes.normalize(b)


def test_lookalike_pairs(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "ａbc"), (3, "abc"), (4, "Abc"), (5, None), (6, ""), (7, "а​bc")], "k long, t string").withColumn("form", F.lit(1))
    assert {(r.key_a, r.key_b) for r in lookalikes.lookalike_pairs(df, "k", "t").collect()} == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7)}
    assert lookalikes.normalize(None) is None and lookalikes.normalize("") == ""


# ---- 6 -------------------------------------------------------------------------------------------
def test_tree_concatenation():
    enc = tokens.encoder(VOCAB)
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a", "the ", "'re", "'", " '", "''", "\n\n", "  ", "\t", "\x1c", "\xa0", "学习", "。", "12", "é", "…", "don't", "!!"]) for _ in range(rng.randint(2, 200)))
        n = rng.choice([1, 7, 30])
        assert tokens.join_tree(enc, [(t[i : i + n], enc.encode_ordinary(t[i : i + n])) for i in range(0, len(t), n)]) == enc.encode_ordinary(t)
    long = "".join(rng.choice("abcdxyzé学") for _ in range(5000))
    assert tokens.encode_text(long, enc, 64) == enc.encode_ordinary(long)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "患者应口服本品血压复查并且停用铁剂", "患者应口服，。本品!"])
def test_joins_encode_little_again(letters, monkeypatch):
    enc = tokens.encoder(VOCAB)
    rng = random.Random(3)
    t = "".join(rng.choice(letters) for _ in range(60_000))
    parts = [(t[i : i + 4096], tokens.encode_text(t[i : i + 4096], enc)) for i in range(0, len(t), 4096)]
    again = []
    plain, whole = enc._core_bpe, tokens.encode_text

    class Core:
        def __getattr__(self, name):
            return getattr(plain, name)

        def encode_single_piece(self, data):
            again.append(len(data))
            return plain.encode_single_piece(data)

    monkeypatch.setattr(enc, "_core_bpe", Core())
    monkeypatch.setattr(tokens, "encode_text", lambda x, *a: again.append(len(x.encode())) or whole(x, *a))
    got = tokens.join_tree(enc, parts)
    monkeypatch.undo()
    assert got == tokens.encode_text(t, enc) and sum(again) < 0.05 * len(t.encode())


def test_encode_corpus(spark):
    enc = tokens.encoder(VOCAB)
    texts = [None, "", " ", "<|endoftext|> x", "ab " * 4000, "学" * 3000, "short", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, segment_chars=1000).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert all(enc.decode(v) == (texts[k] or "") for k, v in got.items())
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ("Hello 'world' <|endoftext|>\n\n x", "患者应口服", "a  b\tc"):
        assert t.encode(text, add_special_tokens=False).ids == tokens.encode_text(text, tokens.encoder(VOCAB))


# ---- 7 -------------------------------------------------------------------------------------------
def test_packing(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 5, 60, 300, 700, 1500, 3000, 8192, 20000])) for i in range(3000)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").withColumn("shard", F.lit(9))
    rows = packing.pack(df, shard_items=1500).collect()
    load, seen = {}, {}
    for r in rows:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
    assert max(load.values()) <= 8192
    for i, n in sizes:
        p = sorted(seen[i])
        assert sum(x for _, _, x in p) == n and len(p) == max(1, -(-n // 8192)) and all(s == k * 8192 for k, s, _ in p)
    assert sum(load.values()) / (8192 * len(load)) > 0.95
    assert packing.pack(df.limit(0)).count() == 0


def test_the_program_needs_fewer_containers_than_best_fit():
    m = 100  # half and a bit, quarter and two bits, quarter and a bit, quarter less two bits: best-fit spoils the full combinations
    size = np.array([4160] * 6 * m + [2176] * 6 * m + [2112] * 6 * m + [1920] * 12 * m)
    ids, piece = np.arange(len(size)), np.zeros(len(size), int)
    plain, alone = np.full(len(size), -1), []
    packing.best_fit(np.argsort(-size, kind="stable"), size, plain, alone, 8192)
    where = packing.pack_shard(ids, piece, size, 8192)
    assert np.bincount(where, weights=size).max() <= 8192
    assert len(alone) == 11 * m and len(set(where.tolist())) <= 9.2 * m


def test_best_configuration_keeps_limits():
    rng = np.random.default_rng(2)
    for _ in range(30):
        width, worth, limit = rng.integers(1, 9, 4), rng.random(4), rng.integers(0, 3, 4)
        got = packing.best_configuration(width, worth, limit, 15)
        best = max((sum(w * c for w, c in zip(worth, x)) for x in np.ndindex(*(limit + 1)) if sum(w * c for w, c in zip(width, x)) <= 15))
        assert (got <= limit).all() and (got * width).sum() <= 15 and abs((got * worth).sum() - best) < 1e-9


# ---- 8 -------------------------------------------------------------------------------------------
LEX = {"latin": {"g": {"lorna", "silas", "élodie"}, "f": {"ockenby", "von lautersee", "d'aubrenelle", "o'tarlane"}}, "han": {"g": {"芷", "书岑"}, "f": {"桑", "欧阳"}}}


@pytest.mark.parametrize("text,want", [
    ("Seen by Dr. Lorna Ockenby on", [("name", "Lorna Ockenby")]), ("OCKENBY, Silas T. rang", [("name", "OCKENBY, Silas T.")]), ("The Ockenby index was 3.", []), ("L. O'Tarlane", [("name", "L. O'Tarlane")]),
    ("患者桑芷，身份证号 990308200104172505，现住霖川省岑安市竹影街450号2栋。", [("name", "桑芷"), ("id_number", "990308200104172505"), ("address", "霖川省岑安市竹影街450号2栋")]),
    ("mail lorna+x [at] mail [dot] example [dot] org now", [("email", "lorna+x [at] mail [dot] example [dot] org")]), ("回复 a.b＠example.net，", [("email", "a.b＠example.net")]),
    ("tel. (303) 555-0127 ext. 15.", [("phone", "(303) 555-0127 ext. 15")]), ("手机155 5501 8130，", [("phone", "155 5501 8130")]), ("unter 0049 30 23125 126 oder", [("phone", "0049 30 23125 126")]),
    ("Dose ladder 17-340-2024 mg", []), ("Carton bar code 6903060140017.", []), ("Approval code H20241843, leaflet YBSM2107134.", []), ("Steuer-ID 17040014897, x", [("id_number", "17040014897")]),
    ("Insurance number QQ 42 66 07 D, x", [("id_number", "QQ 42 66 07 D")]), ("lives at 559B Nettle Ct, Apt 3, Great Fenby ZX9 9ZZ. Next", [("address", "559B Nettle Ct, Apt 3, Great Fenby ZX9 9ZZ")]),
    ("33 ter, impasse des Tilleuls,\n00540 Valmont-sur-Brème\n", [("address", "33 ter, impasse des Tilleuls,\n00540 Valmont-sur-Brème")]), ("Handle @leaflet_bot, 3 @ 8 h", []), ("", []), (None, []), ("   ", []),
    ("call five five five one two three four now", []),
])
def test_mentions(text, want):
    names = pii.Names(LEX)
    spans = pii.mentions(text, names)
    assert [(k, text[s:e]) for k, s, e in spans] == want
    if want:
        assert all(v not in pii.mask(text, spans) for _, v in want)


@pytest.mark.parametrize("text,want", [
    ("Patient: Quilla Varnhoeve was seen.", ["Quilla Varnhoeve"]), ("Dr. Quilla T. Varnhoeve wrote; later Varnhoeve, Quilla called, and Q. Varnhoeve.", ["Quilla T. Varnhoeve", "Varnhoeve, Quilla", "Q. Varnhoeve"]),
    ("患者綦毓，身份证号见附件。联系人綦毓，谢谢。", ["綦毓", "綦毓"]), ("The Varnhoeve index was 3.", []), ("家属桑", []),
])
def test_names_announced_in_the_text_itself(text, want):
    for lex in (LEX, {s: {"g": set(), "f": set()} for s in LEX}):
        assert [text[s:e] for k, s, e in pii.mentions(text, pii.Names(lex)) if k == "name"] == want


def test_lexicon_of_all_documents(spark):
    names = [(f"Gi{chr(97 + i // 26)}{chr(97 + i % 26)}o", f"Fa{chr(97 + i // 26)}{chr(97 + i % 26)}ley") for i in range(60)]
    rare = spark.createDataFrame([(f"Seen by Dr. {g} {f} on day {k}.",) for g, f in names for k in range(2)], "text string")
    lex = pii.fit_lexicon(spark.range(60_000).selectExpr("concat('the dose was halved on day ', id) AS text").unionByName(rare), "text")
    assert lex["latin"] == {"g": {g.lower() for g, _ in names}, "f": {f.lower() for _, f in names}}


def test_plain_maps_back():
    t = "x​y a＠b．c (at) д"
    p, a, b = pii.plain(t)
    assert len(p) == len(a) == len(b) and "@" in p and all(0 <= i < j <= len(t) for i, j in zip(a, b))


def test_pii_tables(spark):
    assert pii.p8_found(spark, SF).columns == ["doc_id", "kind", "start_pos", "end_pos"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal(empty, "doc_id", "text").count() == 0
    some = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.org"), (3, "a@b.org")], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    assert pii.find_personal(some, "doc_id", "text").count() == 2
    assert {r.masked for r in pii.mask_personal(some, "doc_id", "text").collect()} == {None, "", "[EMAIL]"}


def test_registered(spark):
    from foliant.llm.queries import oracle_sql, queries
    from tests.harness import difference

    for name, sql in oracle_sql().items():
        assert difference(spark, name, queries()[name], sql) is None, name
    for name in ("p3_pieces", "p4_groups", "p5_forms", "p6_token_counts", "p7_containers", "p2_neighbors"):
        assert queries()[name](spark, SF).count() > 0
