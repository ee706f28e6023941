"""Cutting oversized texts at natural boundaries (problem 3).

One regular expression with bounded quantifiers takes a piece at a time: alternatives stand in the
order of boundary strength (rest of the text, before a sub-heading, line break, sentence end, any of
these earlier, any of these up to the full limit, then a comma or space, then a plain character
cut). Offsets come from an array fold, the overlap from a look back into the piece before; all of
it is built-in SQL, so it stays in the JVM.

Defined results: texts of at most ``limit`` characters and nulls give no rows in ``split_oversized``;
each piece, without its outer white space, has at most ``limit`` characters with its overlap;
concatenating content[start_pos + overlap : end_pos] gives the text again except for white space
between pieces; a repeated key gives its pieces once per row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import read_table

LIMIT = 600
OVERLAP = 60
STRONG = "。！？；"  # fixed value: a boundary stands behind each
WEAK = ".!?"  # fixed value: a boundary only before a space


def piece_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    near, half = limit - overlap, max((limit - overlap) // 2, 1)
    end = rf"(?:(?<=\n)|(?=\n)|(?<=[{STRONG}])|(?<=[{WEAK}])(?= )|\z)"
    return (
        r"(?sU)\s*+(?:"
        rf".{{1,{limit}}}\s*\z"
        rf"|.{{{half},{near}}}\s*(?<=\n)(?=[^\n{STRONG}{WEAK}]{{1,40}}\n)"
        rf"|.{{{half},{near}}}(?:(?=\n)|\s*(?<=\n))"
        rf"|.{{{half},{near}}}(?:(?<=[{STRONG}])|(?<=[{WEAK}])(?= ))"
        rf"|.{{1,{near}}}\s*{end}"
        rf"|.{{1,{limit}}}\s*{end}"
        rf"|.{{{half},{near}}}(?:(?<=[,，、;:：)）])|(?=\s))"
        rf"|.{{1,{near}}}"
        r")|\s+"
    )


def _lookback(overlap: int) -> str:
    """The longest tail of at most ``overlap`` characters that starts at a boundary, a space, or anywhere."""
    return (
        rf"(?sU)(?:(?<=[\n{STRONG}])|(?<=[{WEAK}] ))(?!\s).{{1,{overlap}}}\z"
        rf"|(?<=[\s,，、])(?!\s).{{1,{overlap}}}\z|.{{1,{overlap}}}\z"
    )


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start_pos, end_pos, overlap, natural_end, piece) of each text over the limit."""
    near = limit - overlap
    raw = df.filter(F.length(text) > limit).select(
        F.col(key).alias("key_"), F.col(text).alias("text_"),
        F.expr(f"regexp_extract_all({text}, {_lit(piece_pattern(limit, overlap))}, 0)").alias("raw_"),
    )
    # ends_[i]: characters up to the end of piece i
    placed = raw.withColumn("ends_", F.expr(
        "aggregate(raw_, array(0), (acc, p) -> concat(acc, array(element_at(acc, -1) + length(p))))"
    ))
    rows = placed.select(
        "key_", "text_", F.size("raw_").alias("n_"), F.posexplode(F.expr(
            "transform(raw_, (p, i) -> named_struct('p', p, 'prev', if(i > 0, raw_[i - 1], ''), 'next', if(i + 1 < size(raw_), raw_[i + 1], ''), 'at', ends_[i]))"
        )).alias("no_", "s_"),
    )
    body = F.expr(r"regexp_replace(s_.p, '(?U)^\\s+|\\s+\\z', '')")
    lead = F.expr(r"length(s_.p) - length(regexp_replace(s_.p, '(?U)^\\s+', ''))")
    rows = rows.withColumn("body_", body).withColumn("lead_", lead).filter(F.length("body_") > 0)
    back = F.expr(
        f"if(no_ = 0 OR s_.prev rlike '(?U)^\\\\s*\\\\z', 0, least(lead_ + length(regexp_extract(regexp_replace(s_.prev, '(?U)\\\\s+\\\\z', ''), {_lit(_lookback(overlap))}, 0))"
        f" + length(s_.prev) - length(regexp_replace(s_.prev, '(?U)\\\\s+\\\\z', '')), {overlap}))"
    )
    natural = F.expr(
        f"no_ = n_ - 1 OR s_.p rlike '(\\n|[{STRONG}])\\\\z' OR startswith(s_.next, '\\n') OR (s_.p rlike '[{WEAK}]\\\\z' AND startswith(s_.next, ' ')) OR s_.next rlike '(?U)^\\\\s*\\\\z'"
    )
    rows = rows.withColumn("back_", back).withColumn("back_", F.expr(f"if(back_ + length(body_) > {limit}, greatest(0, {limit} - length(body_)), back_)")).withColumn("natural_", natural)
    first = F.expr("s_.at + lead_")
    start = first - F.col("back_")
    return rows.select(
        F.col("key_").alias(key), F.col("no_").alias("piece_no"), start.cast("int").alias("start_pos"),
        (first + F.length("body_")).cast("int").alias("end_pos"), F.col("back_").cast("int").alias("overlap"),
        F.col("natural_").alias("natural_end"),
        F.expr("substring(text_, int(s_.at + lead_ - back_ + 1), int(length(body_) + back_))").alias("piece"),
    )


def cut_kind(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, cut): 'forced' if any piece of the text had to end away from a boundary, else 'natural'."""
    return (
        split_oversized(df.withColumn("row_", F.monotonically_increasing_id()).withColumn(key, F.struct(F.col(key).alias("k"), "row_")), key, text, limit, overlap)
        .groupBy(key).agg(F.min("natural_end").alias("ok"))
        .select(F.col(f"{key}.k").alias(key), F.when(F.col("ok"), "natural").otherwise("forced").alias("cut"))
    )


def _text_chunks(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks").filter(F.col("type") == "text").select("chunk_key", "content")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return cut_kind(_text_chunks(spark, sf_dir), "chunk_key", "content")


def p3_pieces(spark, sf_dir: str) -> DataFrame:
    return split_oversized(_text_chunks(spark, sf_dir), "chunk_key", "content")
