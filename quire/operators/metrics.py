"""Text, layout, structure and editability metrics of candidates against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t

# The kinds of element that count as native text and native structure.
NATIVE_TEXT = ("text", "title", "heading", "paragraph", "list_item", "caption", "formula", "header", "footer", "footnote", "page_number", "checkbox")
NATIVE_STRUCTURE = ("table",)


def text_metrics(pairs: DataFrame, reference: str = "reference", candidate: str = "candidate") -> DataFrame:
    """Add character and word error rates and accuracies, exact_match, numerical_accuracy and text_score (0.45, 0.35, 0.10
    and 0.10 of the accuracies). Null texts count as empty."""
    rows = pairs.withColumns({"_r": F.coalesce(reference, F.lit("")), "_c": F.coalesce(candidate, F.lit(""))})
    rows = rows.withColumns({"_rw": t.words(F.col("_r")), "_cw": t.words(F.col("_c")), "_rn": t.numbers(F.col("_r")), "_cn": t.numbers(F.col("_c")), "_d": F.levenshtein("_r", "_c")})
    rows = rows.withColumns({"_wd": t.sequence_distance("_rw", "_cw"), "_nd": t.sequence_distance("_rn", "_cn")})
    n = lambda c: F.length(c) if c in ("_r", "_c") else F.size(c)
    rows = rows.withColumns({
        "character_error_rate": t.error_rate(F.col("_d"), n("_r"), n("_c")),
        "word_error_rate": t.error_rate(F.col("_wd"), n("_rw"), n("_cw")),
        "character_accuracy": t.accuracy(F.col("_d"), n("_r"), n("_c")),
        "word_accuracy": t.accuracy(F.col("_wd"), n("_rw"), n("_cw")),
        "exact_match": F.when(F.col("_r") == F.col("_c"), 1.0).otherwise(0.0),
        "numerical_accuracy": t.accuracy(F.col("_nd"), n("_rn"), n("_cn")),
    })
    score = 0.45 * F.col("character_accuracy") + 0.35 * F.col("word_accuracy") + 0.10 * F.col("exact_match") + 0.10 * F.col("numerical_accuracy")
    return rows.withColumn("text_score", score).drop("_r", "_c", "_rw", "_cw", "_rn", "_cn", "_d", "_wd", "_nd")


def f1(matched: Column, reference: Column, candidate: Column) -> Column:
    """Harmonic mean of precision and recall; both empty is 1."""
    p = F.when(candidate > 0, matched / candidate).otherwise((reference == 0).cast("double"))
    r = F.when(reference > 0, matched / reference).otherwise((candidate == 0).cast("double"))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def type_f1(reference: DataFrame, candidate: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Multiset F1 of element types for each key that either side has."""
    count = lambda d, c: d.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias(c))
    both = count(reference, "r").join(count(candidate, "c"), [*keys, kind], "full").na.fill(0, ["r", "c"])
    sums = both.groupBy(*keys).agg(F.sum(F.least("r", "c")).alias("matched"), F.sum("r").alias("reference"), F.sum("c").alias("candidate"))
    return sums.withColumn("type_f1", f1(F.col("matched"), F.col("reference"), F.col("candidate")))


def layout_metrics(pairs: DataFrame, counts: DataFrame, keys: list[str], width: Column, height: Column) -> DataFrame:
    """Means over matched pairs (box columns, and with suffix 2) of IoU, position and size similarity, with element
    precision, recall and F1 from ``counts`` (reference, candidate); layout_score weighs 0.45, 0.20, 0.15, 0.10 (page: 1
    here, as pairs share their page) and 0.10."""
    a, b = g.box(), g.box(suffix="2")
    means = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"), F.avg(g.iou(a, b, 1.0)).alias("mean_iou"), F.avg(g.position_similarity(a, b, width, height)).alias("position"), F.avg(g.size_similarity(a, b)).alias("size"))
    empty = F.when((F.col("reference") == 0) & (F.col("candidate") == 0), 1.0).otherwise(0.0)
    rows = counts.join(means, keys, "left").withColumns({"matched": F.coalesce("matched", F.lit(0)), **{c: F.coalesce(c, empty) for c in ("mean_iou", "position", "size")}})
    rows = rows.withColumn("element_f1", f1(F.col("matched"), F.col("reference"), F.col("candidate")))
    return rows.withColumn("layout_score", 0.45 * F.col("mean_iou") + 0.20 * F.col("position") + 0.15 * F.col("size") + 0.10 + 0.10 * F.col("element_f1"))


def table_accuracy(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, column, row_span, column_span, text) of table pairs: topology, text and span accuracy and 0.35, 0.40 and
    0.25 of them. A cell that one side lacks counts as 0."""
    def sizes(d, p):
        return d.groupBy(*keys).agg(F.max(F.col("row") + F.col("row_span")).alias(f"{p}r"), F.max(F.col("column") + F.col("column_span")).alias(f"{p}c"))

    both = reference.join(candidate.select(*keys, "row", "column", *[F.col(c).alias(f"{c}2") for c in ("row_span", "column_span", "text")]), [*keys, "row", "column"], "full")
    alike = t.accuracy(F.levenshtein("text", "text2"), F.length("text"), F.length("text2"))
    spans = (g.size_ratio(F.col("row_span"), F.col("row_span2")) + g.size_ratio(F.col("column_span"), F.col("column_span2"))) / 2
    cells = both.groupBy(*keys).agg(F.avg(F.coalesce(alike, F.lit(0.0))).alias("cell_text"), F.avg(F.when(F.col("text").isNotNull() & F.col("text2").isNotNull(), spans).otherwise(0.0)).alias("span"))
    shape = sizes(reference, "a").join(sizes(candidate, "b"), keys, "full").na.fill(0)
    rows = cells.join(shape, keys).withColumn("topology", (g.size_ratio(F.col("ar"), F.col("br")) + g.size_ratio(F.col("ac"), F.col("bc"))) / 2)
    return rows.select(*keys, "topology", "cell_text", "span", (0.35 * F.col("topology") + 0.40 * F.col("cell_text") + 0.25 * F.col("span")).alias("table_accuracy"))


def relationship_accuracy(pairs: DataFrame, keys: list[str], reference: str, candidate: str) -> DataFrame:
    """Mean equality of the keys that either of two maps has; 1 without any."""
    both = pairs.select(*keys, reference, candidate, F.explode_outer(F.array_union(F.map_keys(reference), F.map_keys(candidate))).alias("_key"))
    same = F.col(reference)[F.col("_key")].eqNullSafe(F.col(candidate)[F.col("_key")])
    return both.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("_key").isNotNull(), same.cast("double"))), F.lit(1.0)).alias("relationship_accuracy"))


def editability(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of editable, flattened, native text and native structural elements (kind, text, stated, flattened,
    full_page); shares are 0 without elements."""
    worded = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    text, structure = F.col("kind").isin(*NATIVE_TEXT), F.col("kind").isin(*NATIVE_STRUCTURE)
    flat = F.coalesce("flattened", F.lit(False))
    stated = F.col("stated") & (structure | worded)
    can = F.coalesce(stated, (text & worded) | structure) & ~flat
    lost = flat | (F.col("kind").isin("image", "figure") & F.coalesce("full_page", F.lit(False)))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("elements"), F.count_if(can).alias("editable"), F.count_if(lost).alias("flattened"),
        (F.count_if(can) / n).alias("editable_ratio"), (F.count_if(can & text) / n).alias("native_text_ratio"), (F.count_if(can & structure) / n).alias("native_structure_ratio"),
    )


# Weights of the quality profiles.
PROFILES = {
    "balanced": {"text": 0.28, "layout": 0.18, "structure": 0.20, "editability": 0.16, "visual": 0.18},
    "pixel-perfect": {"text": 0.20, "layout": 0.27, "structure": 0.10, "editability": 0.10, "visual": 0.33},
    "editable": {"text": 0.29, "layout": 0.10, "structure": 0.27, "editability": 0.26, "visual": 0.08},
    "data": {"text": 0.38, "layout": 0.10, "structure": 0.30, "editability": 0.17, "visual": 0.05},
    "archival": {"text": 0.19, "layout": 0.27, "structure": 0.11, "editability": 0.09, "visual": 0.34},
    "presentation": {"text": 0.18, "layout": 0.29, "structure": 0.14, "editability": 0.14, "visual": 0.25},
}
ALIASES = {"visual": "pixel-perfect", "fidelity": "pixel-perfect", "replica": "pixel-perfect", "pixel_perfect": "pixel-perfect", "semantic": "editable"}


def profile(name: str) -> dict[str, float]:
    """The weights of a profile or of an alias of one."""
    key = name.strip().lower()
    return PROFILES[ALIASES.get(key, key)]


def fidelity(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add overall_measured (weights of measured components renormalised), overall_strict (missing ones count 0) and
    measurement_coverage. Unmeasured is null, not zero."""
    total = sum(weights.values())
    held = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in weights}
    sums = sum((F.when(F.col(c).isNotNull(), held[c] * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    there = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return rows.withColumns({"overall_measured": F.when(there > 0, sums / there).otherwise(0.0), "overall_strict": sums / total, "measurement_coverage": there / total})
