"""Order-invariant reducers of clusters of observations.

Every reducer groups by ``keys`` and gives the same result for any order and partitioning of its rows.
Null confidence counts as 0.5 in votes and weights and is left out of noisy-or.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized

def _weight(c: str = "confidence"):
    return F.coalesce(F.col(c), F.lit(0.5))


def choose_text(rows: DataFrame, keys: list[str], key_of=normalized) -> DataFrame:
    """Vote on texts (source, text, confidence) by their key (white space and case apart; pass ``folded`` for texts in which
    composed and decomposed letters mix): most distinct sources, then sum and maximum of confidence, then the
    shortest, then the key; of the winning key the most confident text. Adds chosen_text and votes."""
    rows = rows.where(F.col("text").isNotNull()).withColumn("_key", key_of(F.col("text")))
    groups = rows.groupBy(*keys, "_key").agg(
        F.count_distinct("source").alias("votes"),
        F.round(F.sum(_weight()), 9).alias("_sum"),
        F.max(_weight()).alias("_max"),
        F.min(F.length("text")).alias("_len"),
        F.min(F.struct((-_weight()).alias("c"), F.col("source"), F.col("text"))).alias("_best"),
    )
    order = F.struct((-F.col("votes")).alias("a"), (-F.col("_sum")).alias("b"), (-F.col("_max")).alias("c"), F.col("_len"), F.col("_key"))
    return groups.groupBy(*keys).agg(F.min_by(F.struct(F.col("_best.text").alias("t"), F.col("votes").alias("v")), order).alias("w")).select(*keys, F.col("w.t").alias("chosen_text"), F.col("w.v").alias("votes"))


def noisy_or(rows: DataFrame, keys: list[str], column: str = "confidence") -> DataFrame:
    """1 less the product of the misses. Values are folded in order, so sums of floats do not depend on the plan; a
    cluster is as small as its number of sources."""
    held = F.when(F.col(column).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column))))
    folded = F.aggregate(F.array_sort(F.collect_list(held)), F.lit(1.0), lambda a, x: a * (1 - x))
    return rows.groupBy(*keys).agg(F.when(F.count(column) > 0, 1 - folded).alias("confidence"))


def choose_type(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The type with the most weight; ``unknown`` counts a quarter and loses ties, other ties go by name."""
    votes = rows.groupBy(*keys, "kind").agg(F.round(F.sum(_weight() * F.when(F.col("kind") == "unknown", 0.25).otherwise(1.0)), 9).alias("w"))
    order = F.struct((-F.col("w")).alias("w"), (F.col("kind") == "unknown").alias("u"), F.col("kind"))
    return votes.groupBy(*keys).agg(F.min_by("kind", order).alias("kind"), F.max("w").alias("weight"))


def fuse_boxes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means of the corners; the weight is layout_confidence, else confidence, else 0.5, a twentieth of it for
    full-page fallbacks, and 0.01 at least."""
    w = F.coalesce(*[F.col(c) for c in ("layout_confidence", "confidence") if c in rows.columns], F.lit(0.5))
    if "full_page" in rows.columns:
        w = w * F.when(F.col("full_page"), 0.05).otherwise(1.0)
    w = F.greatest(w, F.lit(0.01))
    return rows.groupBy(*keys).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def weighted_median(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The lower weighted median: the first value at which the sum of weights reaches half."""
    sums = rows.groupBy(*keys, column).agg(F.sum(_weight()).alias("_w"))
    w = Window.partitionBy(*keys)
    part = sums.withColumns({"_total": F.round(F.sum("_w").over(w), 9), "_run": F.round(F.sum("_w").over(w.orderBy(column)), 9)})
    return part.where(F.col("_run") * 2 >= F.col("_total")).groupBy(*keys).agg(F.min(column).alias("median"))


def first_known(rows: DataFrame, keys: list[str], columns: list[str], tie: list[str]) -> DataFrame:
    """For each column its value in the most confident row that has one; ties by the named columns."""
    order = F.struct((-_weight()).alias("c"), *[F.col(c) for c in tie])
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def distinct_candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each source and text of a cluster, with its best confidence and number of observations."""
    return rows.groupBy(*keys, "source", "text").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("seen"))


def unique_elements(rows: DataFrame, page: str, order: list[str]) -> DataFrame:
    """The first of the elements of a page with equal text, type and box to a thousandth, and their new order from 0."""
    key = [F.round(c, 3) for c in ("x0", "y0", "x1", "y1")]
    w = Window.partitionBy(page, "text", "kind", *key).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.withColumn("reading_order", F.row_number().over(Window.partitionBy(page).orderBy(*order)) - 1)


def source_type(rows: DataFrame, keys: list[str]) -> DataFrame:
    """hybrid if any source is, or if native meets another known type; else the first of native, scanned, image; else
    unknown."""
    has = lambda t: F.bool_or(F.col("source_type") == t)
    mixed = has("hybrid") | (has("native") & (has("scanned") | has("image")))
    return rows.groupBy(*keys).agg(F.when(mixed, "hybrid").when(has("native"), "native").when(has("scanned"), "scanned").when(has("image"), "image").otherwise("unknown").alias("source_type"))


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrite edges (source, src, kind, ordinal, dst) by (source, element_id, fused_id): plural targets fan out, those
    without a fused element and loops go, and repeated ones keep their least ordinal."""
    to = mapping.select("source", F.col("element_id").alias("dst"), F.col("fused_id").alias("_dst"))
    of = mapping.select("source", F.col("element_id").alias("src"), F.col("fused_id").alias("_src"))
    met = edges.join(of, ["source", "src"]).join(to, ["source", "dst"]).where("_src <> _dst")
    return met.groupBy(F.col("_src").alias("src"), "kind", F.col("_dst").alias("dst")).agg(F.min("ordinal").alias("ordinal"))
