"""Element streams, sections and packing of lines into chunks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import strip

PREAMBLE = "文档头"
CHUNK_LIMIT = 600


def elements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, text): one row per line that is not blank, in reading order, without outer white space."""
    return (
        docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("seq", "line"))
        .select(key, "seq", strip(F.col("line")).alias("text")).filter("text <> ''")
    )


def is_heading(t: Column) -> Column:
    return t.rlike(r"^【[^】]{1,20}】$")


def is_caption(t: Column) -> Column:
    return t.rlike(r"^(表|图)\s*\d+\s*[:：]?\s*")


def is_subheading(t: Column) -> Column:
    """A short line that does not end a sentence; up to 50 characters if it is neither footnote nor formula."""
    n = F.length(t)
    return ~t.rlike("[。；！？]$") & ((n <= 30) | ((n <= 50) & ~t.rlike(r"^[*＊†‡注]") & ~F.contains(t, F.lit("="))))


def element_kind(t: Column) -> Column:
    return F.when(is_heading(t), "heading").when(is_caption(t), "caption").when(is_subheading(t), "subheading").otherwise("paragraph")


def bold_kind(t: Column, bold: Column, n_lines: Column) -> Column:
    """Kind of a block of running text with its type face: captions are bold, sub-headings bold and one line."""
    b = F.coalesce(bold, F.lit(False))
    return F.when(b & is_caption(t), "caption").when(b & (n_lines == 1) & is_subheading(t), "subheading").otherwise("paragraph")


def build_chunks(el: DataFrame, key: str, limit: int = CHUNK_LIMIT) -> DataFrame:
    """(key, id, type, section, sub_section, content, page_start, page_end, char_len, block_id) of elements (key, seq,
    section_no, section, kind, text, page).

    Within a section a sub-heading ends the chunk and opens the next one; a table or figure is a chunk by itself; a
    paragraph that would pass ``limit`` opens the next chunk and is never cut; joining characters do not count for the
    limit but do for char_len. Ids c001... run over the document in reading order, block ids table-01..., figure-01...
    likewise for each type. Null texts are empty; a section without elements gives no chunk.
    """
    w = W.partitionBy(key).orderBy("seq")
    s = W.partitionBy(key, "section_no").orderBy("seq")
    atomic = F.col("kind").isin("table", "figure")
    opens = (F.col("kind") == "subheading") | atomic | F.coalesce(F.lag("kind").over(s).isin("table", "figure"), F.lit(True))
    x = (
        el.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(w))
        .withColumn("sub_section", F.last(F.when(F.col("kind") == "subheading", F.col("text")), True).over(s))
    )
    heads = x.select(key, "seq", "section_no", "section", "sub_section", "kind", "page")
    packed = pack(x.select(key, "island", "seq", "text"), [key, "island"], limit).join(heads, [key, "seq"])
    first = F.min_by(F.struct("section", "sub_section", "kind", "page"), "seq")
    g = packed.groupBy(key, "island", "chunk_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda v: v["text"]), "\n").alias("content"),
        first.alias("f"), F.max_by("page", "seq").alias("page_end"), F.min("seq").alias("seq"),
    )
    type_ = F.when(F.col("f.kind").isin("table", "figure"), F.col("f.kind")).otherwise("text")
    g = g.withColumn("type", type_)
    nth = F.row_number().over(W.partitionBy(key, "type").orderBy("seq"))
    return g.select(
        key, F.format_string("c%03d", F.row_number().over(w)).alias("id"), "type", F.col("f.section").alias("section"), F.col("f.sub_section").alias("sub_section"), "content",
        F.col("f.page").alias("page_start"), "page_end", F.length("content").alias("char_len"), F.when(F.col("type") != "text", F.concat("type", F.format_string("-%02d", nth))).alias("block_id"),
    )


HEADING = r"^(#{1,6})\s+(.*)$"


def markdown_chunks(docs: DataFrame, key: str, text: str, limit: int = CHUNK_LIMIT) -> DataFrame:
    """(key, id, section, content, char_len) of Markdown texts: a heading line ends the chunk and names the section from there
    on; a line is taken first and the chunk ends behind it once it holds more than ``limit`` characters; chunks without
    text are dropped, outer white space goes. Null texts give none."""
    w = W.partitionBy(key).orderBy("seq")
    head = F.col("t").rlike(HEADING)
    x = (
        docs.select(F.col(key), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("seq", "text")).withColumn("t", strip(F.col("text")))
        .withColumn("island", F.sum(head.cast("int")).over(w))
        .withColumn("section", F.coalesce(F.last(F.when(head, strip(F.regexp_extract("t", HEADING, 2))), True).over(w), F.lit(PREAMBLE)))
    )
    packed = pack(x.filter(~head).select(key, "island", "section", "seq", "text"), [key, "island", "section"], limit, over=True)
    body = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda v: v["text"]), "\n"))
    g = packed.groupBy(key, "island", "section", "chunk_no").agg(body.alias("content"), F.min("seq").alias("seq")).filter("content <> ''")
    return g.select(key, F.format_string("c%03d", F.row_number().over(w)).alias("id"), "section", "content", F.length("content").alias("char_len"))


def fill_sections(el: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds section_id, section and sub_section: each line belongs to the last heading, sub-headings end with their section."""
    w = W.partitionBy(key).orderBy("seq")
    s = W.partitionBy(key, "section_id").orderBy("seq")
    kind = element_kind(F.col("text"))
    return (
        el.withColumn("kind", kind)
        .withColumn("section_id", F.sum((F.col("kind") == "heading").cast("int")).over(w).cast("int"))
        .withColumn("section", F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("text")), True).over(w), F.lit(PREAMBLE)))
        .withColumn("sub_section", F.last(F.when(F.col("kind") == "subheading", F.col("text")), True).over(s))
    )


def section_summary(filled: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per section; an empty preamble is left out."""
    return (
        filled.groupBy(key, "section_id", "section")
        .agg(F.count(F.when(F.col("kind") != "heading", 1)).alias("n_items"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        .filter((F.col("n_items") > 0) | (F.col("section") != PREAMBLE))
    )


def pack(lines: DataFrame, keys: list[str], limit: int = CHUNK_LIMIT, over: bool = False, start: str | None = None) -> DataFrame:
    """Adds chunk_no by the greedy fold: a line that would pass the limit starts the next chunk.

    ``over``: the line is taken first and the chunk ends behind it once it is past the limit.
    ``start``: a boolean column; such a line always starts a chunk. Lines are never cut; joining
    characters do not count. The fold runs on the ordered lengths of one document.
    """
    item = F.struct("seq", F.length("text").alias("n"), (F.col(start) if start else F.lit(False)).alias("s"), *[F.col(c) for c in lines.columns if c not in (*keys, "seq", start)])
    rows = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("it")))).alias("items"))
    if over:
        step = (
            "named_struct('len', cast(if(acc.len + x.it.n > {l}, 0, acc.len + x.it.n) as bigint), 'no', cast(if(acc.len + x.it.n > {l}, acc.no + 1, acc.no) as int), 'out', concat(acc.out, array(acc.no)))"
        )
    else:
        step = (
            "named_struct('len', cast(if((acc.len + x.it.n > {l} or x.it.s) and acc.len > 0, x.it.n, acc.len + x.it.n) as bigint),"
            " 'no', cast(if((acc.len + x.it.n > {l} or x.it.s) and acc.len > 0, acc.no + 1, acc.no) as int),"
            " 'out', concat(acc.out, array(cast(if((acc.len + x.it.n > {l} or x.it.s) and acc.len > 0, acc.no + 1, acc.no) as int))))"
        )
    fold = f"aggregate(items, named_struct('len', 0L, 'no', 0, 'out', cast(array() as array<int>)), (acc, x) -> {step.format(l=limit)}, acc -> acc.out)"
    return (
        rows.withColumn("no", F.expr(fold))
        .select(*keys, F.explode(F.arrays_zip("items", "no")).alias("z"))
        .select(*keys, F.col("z.items.seq").alias("seq"), F.col("z.items.it.text").alias("text"), F.col("z.no").alias("chunk_no"))
    )


def chunks(packed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per chunk: text in order, length without joining characters, ids c001... per document."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    g = packed.groupBy(*keys, "chunk_no").agg(body.alias("content"), F.sum(F.length("text")).alias("char_len"), F.min("seq").alias("seq"))
    return g.withColumn("id", F.format_string("c%03d", F.row_number().over(W.partitionBy(keys[0]).orderBy("seq"))))
