"""One form for text that looks the same but is made of other characters (problem 5).

A transducer is compiled before the first text: every character and every cluster of a base with
combining marks (or of Hangul parts) that Unicode composes goes to one form, and one left-to-right pass
takes the longest match. The mapping is computed from Unicode's own decompositions (canonical, <wide>,
<narrow>, <font>, ligatures, radicals, Roman numerals, kinds of space) plus a list of letters of other
scripts that look like a Latin one, then checked: applying it twice changes nothing, and characters that
must stay apart (case, raised digits, ASCII, line breaks) do. Clusters that no single character stands
for (a base with several marks) go through the same mapping and the canonical order of marks.

Defined results: null -> null, empty -> empty; line breaks and tabs stay; several spaces stay
several; upper and lower case, raised and plain digits stay apart.
"""
from __future__ import annotations

import re
import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut, read_table

# Letters of other scripts and blocks that look like the Latin one they stand before.
LOOKALIKE = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧ", "I": "ΙІӀꓲ", "J": "ЈͿᎫꓙ",
    "K": "ΚКᏦꓗ", "L": "Ꮮꓡ", "M": "ΜМϺᎷꓟ", "N": "Νꓠ", "O": "ΟОՕꓳ", "P": "ΡРᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ",
    "X": "ΧХꓫ", "Y": "ΥҮꓬ", "Z": "ΖᏃꓜ", "a": "аɑ", "c": "сϲᴄ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іı",
    "j": "јϳ", "l": "ӏ", "o": "οоօᴏ", "p": "рρ", "q": "ԛ", "s": "ѕꜱ", "u": "υս", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уү", "z": "ᴢ",
    "μ": "µ", "-": "‐‑", "'": "ʼ",
}
# Characters that must never be merged with another.
APART = "²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉αβ–—·×"
def _invisible(c: str) -> bool:
    o = ord(c)
    return ud.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D)


def _one(c: str, alike: dict[str, str]) -> str:
    if c in "\n\r\t" or c in APART:
        return c
    if _invisible(c):
        return ""
    if ud.category(c) == "Zs":
        return " "
    out = []
    for d in ud.normalize("NFD", c):
        how = ud.decomposition(d)
        o = ord(d)
        if how.startswith(("<wide>", "<narrow>", "<noBreak>")) or (how.startswith("<font>") and 0x1D400 <= o <= 0x1D7FF) or (
            how.startswith("<compat>") and (0x2E80 <= o <= 0x2FDF or 0xFB00 <= o <= 0xFB06 or 0x2160 <= o <= 0x217F or 0x2002 <= o <= 0x200A or o in (0x2103, 0x2109))
        ):
            d = ud.normalize("NFKD", d)
        out += [alike.get(x, x) for x in d]
    return ud.normalize("NFC", "".join(out))


def _mapped(c: str, table: dict[str, str]) -> str:
    """The form of a cluster: its parts one by one, marks in canonical order."""
    m = ud.normalize("NFC", "".join(table.get(x, x) for x in ud.normalize("NFD", c)))
    return ud.normalize("NFC", "".join(table.get(x, x) for x in m))


@lru_cache(maxsize=1)
def transducer() -> tuple[re.Pattern, dict[str, str]]:
    alike = {x: k for k, v in LOOKALIKE.items() for x in v}
    table: dict[str, str] = {}
    marks: list[str] = []
    composed: list[str] = []
    for o in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= o <= 0xDFFF or 0xAC00 <= o <= 0xD7A3 or 0x20000 <= o < 0x2F800 or 0x30000 <= o < 0xE0000:
            continue
        c = chr(o)
        if ud.combining(c):
            marks.append(c)
        if ud.decomposition(c)[:1] not in ("", "<"):
            composed.append(c)
        m = _one(c, alike)
        m = ud.normalize("NFC", "".join(_one(x, alike) for x in m))
        if m != c:
            table[c] = m
    clusters: dict[str, str] = {}
    for c in composed:  # each way to write it: wholly apart, and the last mark apart
        for way in {ud.normalize("NFD", c), "".join(chr(int(x, 16)) for x in ud.decomposition(c).split())}:
            if len(way) > 1:
                clusters[way] = _mapped(c, table)
    for c, m in (table | clusters).items():  # conflict check
        again = ud.normalize("NFC", "".join(table.get(x, x) for x in m))
        if again != m:
            raise ValueError(f"{c!r} goes to {m!r}, which goes on to {again!r}")
    for c in APART:
        if c in table:
            raise ValueError(f"{c!r} must stay apart")
    ranges = lambda cs: "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _runs(sorted(map(ord, cs))))
    inv = ranges(c for c, m in table.items() if not m and not ud.combining(c))
    mk, single = ranges(marks), ranges(table)
    hangul = "[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?|[\uac00-\ud7a3][\u11a8-\u11c2]"
    return re.compile(f"{hangul}|[^\\n{mk}{inv}][{inv}]*[{mk}][{mk}{inv}]*|[{single}]"), table | clusters


def _runs(points: list[int]) -> Iterator[tuple[int, int]]:
    a = b = points[0]
    for p in points[1:]:
        if p == b + 1:
            b = p
        else:
            yield a, b
            a = b = p
    yield a, b


class _Out(dict):
    def __init__(self, table):
        super().__init__(table)
        self.table = table

    def __missing__(self, cluster):  # a base with marks that no character stands for, or with invisible ones between
        self[cluster] = m = _mapped(cluster, self.table)
        return m


_cache: list = []


def normalize(text: str | None) -> str | None:
    """The one form of a text."""
    if text is None or text.isascii():
        return text
    if not _cache:
        pattern, table = transducer()
        _cache.append((pattern, _Out(table)))
    pattern, out = _cache[0]
    done = pattern.sub(lambda m: out[m.group()], text)
    return done if ud.is_normalized("NFC", done) else ud.normalize("NFC", done)


def normalized(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with a column ``to`` holding the one form of ``text``."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(normalize, na_action="ignore")

    return df.withColumn(to, f(F.col(text)))


def form_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, raw): 128 and 64 bit digests of the one form and of the text as stored; null texts drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form, raw = [], []
            for t in b.column(1).to_pylist():
                n = normalize(t)
                form.append(xxhash.xxh3_128_digest(n))
                raw.append(xxhash.xxh3_128_digest(t) if n is not t else form[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["key", "form", "raw"])

    return df.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, form binary, raw binary")


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: same form, other characters.

    Texts are first brought together by (form, raw); only forms that have two spellings or more go
    into the join, and the members of a spelling are expanded after the spellings have been paired.
    """
    keys = cut(form_keys(df, key, text))  # 40 bytes a row; the texts are read and written plainly once
    spellings = keys.groupBy("form", "raw").agg(F.count("*").alias("n"))
    mixed = spellings.groupBy("form").agg(F.count("*").alias("s")).filter("s > 1").select("form")
    some = spellings.join(mixed, "form", "left_semi").select("form", "raw")
    pairs = some.select("form", F.col("raw").alias("ra")).join(some.select("form", F.col("raw").alias("rb")), "form").filter("ra < rb").select("ra", "rb")
    one = pairs.join(keys.select(F.col("raw").alias("ra"), F.col("key").alias("ka")), "ra")
    both = one.join(keys.select(F.col("raw").alias("rb"), F.col("key").alias("kb")), "rb")
    return both.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    content = lookalike_pairs(read_table(spark, sf_dir, "chunks"), "chunk_key", "content").withColumn("field", F.lit("content"))
    cat = form_keys(read_table(spark, sf_dir, "drug_catalogue"), "drug_id", "generic_name")
    leaf = form_keys(read_table(spark, sf_dir, "leaflets").select("leaflet_key", F.col("meta.`通用名称`").alias("name")), "leaflet_key", "name")
    names = (
        cat.select("form", F.col("raw").alias("ra"), F.col("key").alias("key_a"))
        .join(leaf.select("form", F.col("raw").alias("rb"), F.col("key").alias("key_b")), "form")
        .filter("ra <> rb").select("key_a", "key_b").withColumn("field", F.lit("generic_name"))
    )
    return content.unionByName(names).select("field", "key_a", "key_b")


def p5_forms(spark, sf_dir: str) -> DataFrame:
    return normalized(read_table(spark, sf_dir, "chunks").select("chunk_key", "content"), "content", "form").select("chunk_key", "form")


def p5_names(spark, sf_dir: str) -> DataFrame:
    """The one form of each leaflet's generic name."""
    return normalized(read_table(spark, sf_dir, "leaflets").select("leaflet_key", F.col("meta.`通用名称`").alias("name")), "name", "form").select("leaflet_key", "form")


def p5_classes(spark, sf_dir: str) -> DataFrame:
    """(chunk_key, class_key, n_texts, n_spellings): texts of one form as a class with its smallest key; no pairs, so a form
    of many rows costs its rows. Classes of one row are left out; null contents take no part."""
    keys = cut(form_keys(read_table(spark, sf_dir, "chunks"), "chunk_key", "content"))
    spellings = keys.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    classes = spellings.groupBy("form").agg(F.min("first").alias("class_key"), F.sum("n").alias("n_texts"), F.count("*").alias("n_spellings")).filter("n_texts > 1")
    return keys.join(classes, "form").select(F.col("key").alias("chunk_key"), "class_key", "n_texts", "n_spellings")
