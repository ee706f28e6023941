"""Rules that route documents and images."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_CHARS, HYBRID_CHARS, SCANNED_RATIO, TEXT_SHARE, SCANNED_SHARE = 100, 10, 0.5, 0.9, 0.5
ENGINE = {"text": "pymupdf", "hybrid": "mineru", "scanned": "mineru"}
FORCED = {"text": "text", "pymupdf": "text", "hybrid": "hybrid", "scanned": "scanned", "mineru": "scanned"}


def page_kind(chars: Column, ratio: Column) -> Column:
    """A null ratio counts as no image."""
    return F.when(chars >= TEXT_CHARS, "text").when(chars >= HYBRID_CHARS, "hybrid").when(F.coalesce(ratio, F.lit(0.0)) >= SCANNED_RATIO, "scanned").otherwise("blank")


def document_kind(pages: DataFrame, key: str) -> DataFrame:
    """One row per document: counts per page kind, shares of the pages that are not blank, kind and reason."""
    p = pages.withColumn("kind", page_kind(F.col("text_chars"), F.col("image_area_ratio")))
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    g = p.groupBy(key).agg(F.count("*").alias("n_pages"), n("text"), n("hybrid"), n("scanned"), n("blank"))
    eff = F.col("n_pages") - F.col("n_blank")
    g = g.withColumn("text_ratio", F.round(F.coalesce(F.try_divide("n_text", eff), F.lit(1.0)), 4)).withColumn("scanned_ratio", F.round(F.coalesce(F.try_divide("n_scanned", eff), F.lit(0.0)), 4))
    kind = F.when(eff == 0, "text").when(F.col("scanned_ratio") >= SCANNED_SHARE, "scanned").when(F.col("text_ratio") >= TEXT_SHARE, "text").otherwise("hybrid")
    reason = F.when(eff == 0, "no effective page").otherwise(F.concat(F.col("n_text"), F.lit(" text, "), F.col("n_scanned"), F.lit(" scanned of "), eff))
    return g.withColumn("doc_kind", kind).withColumn("reason", reason)


def engine_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ENGINE.items() for x in kv]), kind)


RULES = (  # column, comparison, bound, points, name
    ("text_ratio", "<", 0.15, 2, "low_text"), ("text_ratio", ">", 0.4, -2, "high_text"), ("image_entropy", ">", 6.5, 2, "high_entropy"), ("image_entropy", "<", 4.5, -1, "low_entropy"),
    ("edge_density", ">", 0.12, 1, "many_edges"), ("color_variance", ">", 800, 2, "rich_color"), ("color_variance", "<", 100, -1, "flat_color"), ("num_connected_components", ">", 500, -1, "many_components"),
)


def rule_score() -> Column:
    return sum((F.when(F.expr(f"{c} {op} {b}"), p).otherwise(0) for c, op, b, p, _ in RULES), F.lit(0))


def rule_reasons() -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.expr(f"{c} {op} {b}"), f"{n}{p:+d}") for c, op, b, p, n in RULES])), "|")


def character_spread(text: Column) -> Column:
    """(entropy, variance): bits per character and population variance of the code points of a text; null where there is none."""

    @F.arrow_udf("struct<entropy: double, variance: double>")
    def spread(texts: pa.Array) -> pa.Array:
        entropy, variance = [], []
        for t in texts.to_pylist():
            if not t:
                entropy.append(None)
                variance.append(None)
                continue
            codes, n = np.unique(np.frombuffer(t.encode("utf-32-le"), np.uint32), return_counts=True)
            p = n / n.sum()
            entropy.append(float(-(p * np.log2(p)).sum()))
            variance.append(float((p * (codes - (p * codes).sum()) ** 2).sum()))
        return pa.StructArray.from_arrays([pa.array(entropy, pa.float64()), pa.array(variance, pa.float64())], names=["entropy", "variance"])

    return spread(text)


def decision(score: Column, chars: Column, conf: Column) -> Column:
    """Only rows between the two sure bands need the probe."""
    return (
        F.when(score >= 3, "vlm").when(score <= -1, "ocr").when(chars == 0, "vlm")
        .when((chars > 50) & (conf > 0.85), "ocr").when(chars < 10, "vlm").otherwise("hybrid")
    )
