"""Encoding of a corpus with a public byte-level BPE tokenizer by tree concatenation (problem 6).

Short texts are encoded whole. A text longer than ``segment_chars`` is cut into segments that are
encoded on different tasks; a single unsplit run (letters without a break) longer than
``piece_bytes`` is halved recursively. Two neighbouring encodings are joined by re-encoding a
growing window around the join until its first token equals the left side's token at the window's
start and its last token equals the right side's at the window's end. For BPE by rank a sequence is
the encoding of its text exactly if each neighbouring pair of tokens is stable, so such agreement
makes the concatenation exact. Where the kind of character changes at the join (letter, digit, sign,
white space; in any script), a pre-token ends there and nothing is encoded again; where a run goes on
across it, the window grows over the tokens of that run only; the few other cases (white space on both
sides, apostrophes) use a window that ends at boundaries which both scans share.

Defined results: null and empty text -> empty list; the spelling of a special token is ordinary
text; one row per input row, repeated rows stay repeated; extra columns are dropped.
"""
from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import read_table

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenizer pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEGMENT_CHARS = 16384
PIECE_BYTES = 2048


@lru_cache(maxsize=4)
def encoder(vocab: str = DEFAULT_VOCAB):
    import tiktoken

    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(vocab), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=1)
def _long_run():
    import regex

    return regex.compile(r"\p{L}{700}|\p{N}{700}|[^\s\p{L}\p{N}]{700}|\s{700}")


def join_piece(enc, left: list[int], right: list[int]) -> list[int]:
    """Exact BPE of one unsplit piece from the encodings of its two parts."""
    if not left or not right:
        return left + right
    a = b = 2
    while True:
        a, b = min(a, len(left)), min(b, len(right))
        window = enc.decode_bytes(left[-a:] + right[:b])
        mid = list(enc._core_bpe.encode_single_piece(window))
        left_ok = a == len(left) or mid[0] == left[-a]
        right_ok = b == len(right) or mid[-1] == right[b - 1]
        if left_ok and right_ok:
            return left[: len(left) - a] + mid + right[b:]
        if not left_ok:
            a *= 2
        if not right_ok:
            b *= 2


def encode_piece(enc, data: bytes, piece_bytes: int = PIECE_BYTES) -> list[int]:
    """One unsplit piece: halves are encoded on their own and joined."""
    if len(data) <= piece_bytes:
        return list(enc._core_bpe.encode_single_piece(data))
    h = len(data) // 2
    return join_piece(enc, encode_piece(enc, data[:h], piece_bytes), encode_piece(enc, data[h:], piece_bytes))


def encode_text(text: str | None, enc, piece_bytes: int = PIECE_BYTES) -> list[int]:
    if not text:
        return []
    if len(text) < 700 or not _long_run().search(text):
        return enc.encode_ordinary(text)
    out: list[int] = []
    for m in _pattern().finditer(text):
        out += encode_piece(enc, m.group().encode(), piece_bytes)
    return out


def _starts(text: str) -> list[int]:
    return [m.start() for m in _pattern().finditer(text)]


_WHITE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


def _kind(c: str) -> str:
    """L letter, N number, S white space, O sign; ? where tables of characters may differ."""
    if c in _WHITE:
        return "S"
    k = unicodedata.category(c)
    return "?" if k in ("Cn", "Co", "Cs") or c.isspace() else k[0] if k[0] in "LN" else "O"


@lru_cache(maxsize=1)
def _runs():
    import regex

    body = {"L": r"\p{L}", "N": r"\p{N}", "O": r"[^\s\p{L}\p{N}]"}
    return {k: (regex.compile(rf"(?r)[ ]?{v}+\Z"), regex.compile(rf"{v}+")) for k, v in body.items()}


def _ends_between(a: str, b: str) -> bool:
    """Does a pre-token end between these characters whatever stands around them?"""
    x, y = _kind(a), _kind(b)
    if "?" in (x, y) or x == y or x == "S":
        return False
    return y == "S" or not (a == "'" and y == "L")


def join_texts(enc, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
    """Encoding of left+right from the encodings of both."""
    if not left or not right:
        return left_ids + right_ids
    if _ends_between(left[-1], right[0]):
        return left_ids + right_ids
    x, y = _kind(left[-1]), _kind(right[0])
    if y in "LNO" and x in (y, "S") and right[0] != "'":
        run = _runs()[y][1].match(right).group()
        n_right = _count_tokens(enc, right_ids, run, from_end=False)
        if x == y:
            tail = _runs()[y][0].search(left).group()
            n_left = _count_tokens(enc, left_ids, tail, from_end=True)
            if tail.strip(" ")[:1] != "'" and not (y == "L" and left[: len(left) - len(tail)].endswith("'") and tail[0] != " ") and n_left and n_right:
                k = len(left_ids) - n_left
                return left_ids[:k] + join_piece(enc, left_ids[k:], right_ids[:n_right]) + right_ids[n_right:]
        else:
            white = left[len(left.rstrip("".join(_WHITE))) :]
            n_left = _count_tokens(enc, left_ids, white, from_end=True)
            if n_left and n_right:  # all but the last are a pre-token, a last space belongs to what follows
                before = encode_piece(enc, white[:-1].encode()) if len(white) > 1 else []
                last = list(enc._core_bpe.encode_single_piece(white[-1].encode()))
                after = join_piece(enc, last, right_ids[:n_right]) if white[-1] == " " else last + right_ids[:n_right]
                return left_ids[: len(left_ids) - n_left] + before + after + right_ids[n_right:]
    return _join_windows(enc, left, left_ids, right, right_ids)


def _join_windows(enc, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
    """The same with a growing window of pre-tokens.

    Scanning is deterministic to the right, so where the window's scan and a side's own scan share a
    boundary, both agree from there on; on the left a boundary counts only if the pre-token that
    ends there cannot have looked at the join.
    """
    w = 64
    while True:
        whole_l, whole_r = w >= len(left), w >= len(right)
        lo = _boundary_before(left, w) if not whole_l else 0
        tail = left[lo:]
        head = right if whole_r else right[:w]
        scan = _starts(tail + head)
        k = len(tail)
        if whole_r:
            hi = len(right)
        else:
            own = set(_starts(right[: 2 * w]))
            # the last pre-tokens of a cut window depend on text beyond it; behind white space the
            # window's own end would be read otherwise than the text's
            shared = [s - k for s in scan if s > k and (s - k) in own and s - k < w - 8 and not head[s - k - 1].isspace()]
            hi = shared[-1] if shared else -1
        if hi >= 0:
            mid = encode_text(tail + right[:hi], enc)
            n_left = _count_tokens(enc, left_ids, tail, from_end=True)
            n_right = _count_tokens(enc, right_ids, right[:hi], from_end=False)
            if n_left is not None and n_right is not None:
                return left_ids[: len(left_ids) - n_left] + mid + right_ids[n_right:]
        w *= 2


def _boundary_before(left: str, w: int) -> int:
    """A pre-token start of ``left`` at least ``w`` characters before its end, valid in the whole text."""
    i = len(left) - w
    while i > 0 and not _ends_between(left[i - 1], left[i]):
        i -= 1
    return max(i, 0)


@lru_cache(maxsize=4)
def _sizes(enc) -> list[int]:
    return [len(enc.decode_single_token_bytes(t)) for t in range(enc.max_token_value + 1)]


def _count_tokens(enc, ids: list[int], part: str, from_end: bool) -> int | None:
    """How many tokens at the end (start) of ids spell exactly ``part``; None if none do."""
    need, got, n, size = len(part.encode()), 0, 0, _sizes(enc)
    for t in reversed(ids) if from_end else ids:
        if got >= need:
            break
        got += size[t]
        n += 1
    return n if got == need else None


def join_tree(enc, parts: list[tuple[str, list[int]]]) -> list[int]:
    while len(parts) > 1:
        nxt = []
        for i in range(0, len(parts) - 1, 2):
            (a, x), (b, y) = parts[i], parts[i + 1]
            nxt.append((a + b, join_texts(enc, a, x, b, y)))
        if len(parts) % 2:
            nxt.append(parts[-1])
        parts = nxt
    return parts[0][1] if parts else []


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((t for x in ids for t in x), np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB,
    segment_chars: int = SEGMENT_CHARS, piece_bytes: int = PIECE_BYTES, count_only: bool = False,
) -> DataFrame:
    """(id, ids ARRAY<INT>) for each row, or (id, n_tokens INT) with ``count_only``."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fits = F.col("text").isNull() | (F.length("text") <= segment_chars)
    out = "doc_id long, n_tokens int" if count_only else "doc_id long, ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            ids = [encode_text(t, enc, piece_bytes) for t in b.column(1).to_pylist()]
            second = pa.array([len(x) for x in ids], pa.int32()) if count_only else _lists(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), second], names=["doc_id", "n_tokens" if count_only else "ids"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for b in batches:
            ids = [encode_text(t, enc, piece_bytes) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), _lists(ids)], names=["doc_id", "row", "seg", "part", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        enc = encoder(vocab)
        t = table.sort_by("seg")
        ids = join_tree(enc, list(zip(t.column("part").to_pylist(), t.column("ids").to_pylist())))
        second = pa.array([len(ids)], pa.int32()) if count_only else _lists([ids])
        return pa.Table.from_arrays([pa.array([t.column("doc_id")[0].as_py()], pa.int64()), second], names=["doc_id", "n_tokens" if count_only else "ids"])

    short = src.filter(fits).mapInArrow(whole, out)
    cut = (
        src.filter(~fits)
        .withColumn("row", F.xxhash64("doc_id", "text"))
        .withColumn("copy", F.monotonically_increasing_id())
        .select("doc_id", F.concat_ws(":", "row", "copy").alias("row"), F.posexplode(F.expr(
            f"transform(sequence(0, int((length(text) - 1) / {segment_chars})), i -> substring(text, i * {segment_chars} + 1, {segment_chars}))"
        )).alias("seg", "part"))
    )
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    long = (
        cut.repartition(n, "doc_id", "row", "seg")
        .mapInArrow(segments, "doc_id long, row string, seg int, part string, ids array<int>")
        .groupBy("row").applyInArrow(joined, out)
    )
    return short.unionByName(long)


def p6_ids(spark, sf_dir: str, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"), vocab=vocab)


def p6_token_counts(spark, sf_dir: str, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """Tokens of each document, without moving the ids."""
    return encode_corpus(read_table(spark, sf_dir, "documents"), vocab=vocab, count_only=True)
