"""Boxes, table fragments and captions of a page's elements."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_ratio(a: str, b: str) -> Column:
    """Intersection of boxes a and b over the area of a; 0 where a has none."""
    w = F.greatest(F.lit(0.0), F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0"))
    area = (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{a}.y1") - F.col(f"{a}.y0"))
    return F.when(area > 0, w * h / area).otherwise(0.0)


def outside_tables(blocks: DataFrame, tables: DataFrame, on: list[str], most: float = 0.5) -> DataFrame:
    """Blocks that no table of the same page covers by more than ``most``; blocks and tables have ``box``."""
    b, t = blocks.alias("b"), tables.select(*on, F.col("box").alias("tbox")).alias("t")
    cond = [F.col(f"b.{c}") == F.col(f"t.{c}") for c in on]
    c = cond[0]
    for x in cond[1:]:
        c = c & x
    return b.join(t, c & (overlap_ratio("box", "tbox") > most), "left_anti")


def merge_islands(tables: DataFrame, key: str) -> DataFrame:
    """Table fragments that follow each other within a page and have the same columns are one table."""
    w = W.partitionBy(key).orderBy("seq")
    new = F.lag("cols").over(w).isNull() | (F.col("cols") != F.lag("cols").over(w)) | (F.col("page") - F.lag("page").over(w) > 1) | (F.col("seq") - F.lag("seq").over(w) > 1)
    g = tables.withColumn("table_no", F.sum(new.cast("int")).over(w).cast("int"))
    return g.groupBy(key, "table_no").agg(F.min("page").alias("page"), F.max("page").alias("page_end"), F.max("cols").alias("cols"), F.sum("n_rows").cast("long").alias("n_rows"), F.count("*").alias("merged"))


FIGURE_CAPTION = r"^图\s*\d+"


def attach_captions(el: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, text, page, caption) of elements (key, seq, kind, text, page, y0), in reading order.

    A caption opens a window that ends before the next caption. A table caption belongs to the element directly behind it
    if that is a table or figure. A figure caption belongs to every figure of its window before the first table that is
    on its page and not above it (``y0`` one less is still level) or on the next page. A figure caption directly behind a
    figure that has none, while no caption waits, belongs to that figure and opens no window. A caption that belongs to
    nothing is a paragraph: a table caption in its place, a figure caption where its window ends (the first table, or the
    next caption). Null y0 counts as 0.
    """
    doc = W.partitionBy(key).orderBy("seq")
    own = W.partitionBy(key, "win")
    order = own.orderBy("seq")
    is_cap = F.col("kind") == "caption"
    x = el.withColumn("win", F.sum(is_cap.cast("int")).over(doc)).withColumn("y_", F.coalesce("y0", F.lit(0.0)))
    for name, value in (("cap", F.col("text")), ("cap_page", F.col("page")), ("cap_y", F.col("y_"))):
        x = x.withColumn(name, F.first(F.when(is_cap, value)).over(order))
    x = (
        x.withColumn("is_fig", F.coalesce(F.col("cap").rlike(FIGURE_CAPTION), F.lit(False)))
        .withColumn("nth", F.row_number().over(order) - F.when(F.col("win") > 0, 1).otherwise(0))  # 0: the caption itself
        .withColumn("after_table", F.coalesce(F.max((F.col("kind") == "table").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0)
    )
    in_reach = ((F.col("page") == F.col("cap_page")) & (F.col("y_") >= F.col("cap_y") - 1)) | (F.col("page") == F.col("cap_page") + 1)
    below = F.when(F.col("win") == 0, False).when(is_cap, False).when(
        F.col("is_fig"), (F.col("kind") == "figure") & ~F.col("after_table") & in_reach
    ).otherwise((F.col("nth") == 1) & F.col("kind").isin("table", "figure"))
    x = x.withColumn("below", F.coalesce(below, F.lit(False)))
    # one row per window: does its own caption wait at its end, is its last element a figure left without one
    win = x.groupBy(key, "win").agg(
        F.first("is_fig").alias("fig"), F.max("below").alias("hit"), F.max((F.col("kind") == "table").cast("int")).alias("has_table"),
        F.max("nth").alias("n"), F.max_by("kind", "seq").alias("last_kind"), F.max_by("below", "seq").alias("last_below"),
    )
    per = W.partitionBy(key).orderBy("win")
    before = lambda c: F.lag(c).over(per)
    may = F.col("fig") & F.coalesce((before("last_kind") == "figure") & (before("n") >= 1), F.lit(False))
    waits = F.when(before("fig"), ~before("hit") & (before("has_table") == 0)).otherwise(before("n") == 0)
    free = (before("win") == 0) | (~before("last_below") & ~waits)
    # a window that opened none leaves its figures free, so a run of captions behind figures goes back as a whole once one does
    win = win.withColumn("may", may).withColumn("sure", may & F.coalesce(free, F.lit(False))).withColumn("run", F.sum((~F.col("may")).cast("int")).over(per))
    win = win.withColumn("back", F.max("sure").over(W.partitionBy(key, "run").orderBy("win")) & F.col("may"))
    win = win.withColumn("next_back", F.coalesce(F.lead("back").over(per), F.lit(False))).select(key, "win", "back", "hit", "next_back")
    y = x.join(win, [key, "win"]).withColumn("below", F.col("below") & ~F.col("back")).withColumn("last", F.row_number().over(own.orderBy(F.desc("seq"))) == 1)
    next_cap = F.lead("text").over(doc)
    y = y.withColumn("caption", F.when(F.col("below"), F.col("cap")).when(F.col("last") & F.col("next_back"), next_cap))
    first_table = F.min(F.when(F.col("kind") == "table", F.col("seq"))).over(own)
    end = F.max("seq").over(own)
    lost = is_cap & ~F.col("back") & ~F.col("hit")
    y = y.withColumn("at", F.when(lost & F.col("is_fig"), F.coalesce(first_table, end)).otherwise(F.col("seq"))).withColumn("turn", F.when(lost & F.col("is_fig"), F.when(first_table.isNotNull(), -1).otherwise(1)).otherwise(0))
    kept = y.filter(~is_cap | lost).withColumn("kind", F.when(is_cap, "paragraph").otherwise(F.col("kind")))
    place = W.partitionBy(key).orderBy("at", "turn")
    return kept.withColumn("pos", F.row_number().over(place) - 1).select(key, "pos", "kind", "text", "page", "caption")
