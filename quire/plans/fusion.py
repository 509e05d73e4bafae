"""The flagship plan: observations of several sources to one consensus element per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import matching


def _sum(values: Column) -> Column:
    return F.aggregate(F.array_sort(values), F.lit(0.0), lambda a, x: a + x)


def fuse(observations: DataFrame) -> DataFrame:
    """Cluster each page (matching.fuse_pages) and reduce every cluster: page_id, cluster, reading_order (from 0), kind,
    box, text, votes, confidence and sources.

    A cluster has at most one observation of a source, so all of its reducers work on one list of them, gathered by at most
    one shuffle: the same results as consensus.fuse_boxes, choose_type, choose_text (by the folded key) and noisy_or.
    """
    rows = matching.clustered(observations)
    sure = F.coalesce("confidence", F.lit(0.5))
    one = F.struct("source", "element_id", "kind", "text", "key", "confidence", sure.alias("w"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    rows = rows.select("page_id", "cluster", one.alias("o")).groupBy("page_id", "cluster").agg(F.array_sort(F.collect_list("o")).alias("o"))
    weights = F.transform("o", lambda x: F.greatest(x["w"], F.lit(0.01)))
    edge = lambda c: F.transform("o", lambda x: x[c] * F.greatest(x["w"], F.lit(0.01)))
    box = {c: _sum(edge(c)) / _sum(weights) for c in ("x0", "y0", "x1", "y1")}

    def of(field: str, value: Column) -> Column:
        return F.filter("o", lambda x: x[field] == value)

    kinds = F.transform(F.array_distinct(F.transform("o", lambda x: x["kind"])), lambda k: F.struct((-F.round(_sum(F.transform(of("kind", k), lambda x: x["w"] * F.when(k == "unknown", 0.25).otherwise(1.0))), 9)).alias("w"), (k == "unknown").alias("u"), k.alias("kind")))
    keys = F.array_distinct(F.filter(F.transform("o", lambda x: x["key"]), lambda k: k.isNotNull()))

    def vote(k: Column) -> Column:
        own = of("key", k)
        return F.struct(
            (-F.size(F.array_distinct(F.transform(own, lambda x: x["source"])))).alias("votes"), (-F.round(_sum(F.transform(own, lambda x: x["w"])), 9)).alias("s"), (-F.array_max(F.transform(own, lambda x: x["w"]))).alias("m"),
            F.array_min(F.transform(own, lambda x: F.length(x["text"]))).alias("l"), k.alias("key"),
        )

    rows = rows.withColumns({"_kind": F.array_min(kinds), "_vote": F.array_min(F.transform(keys, vote)), **box})
    best = F.array_min(F.transform(of("key", F.col("_vote.key")), lambda x: F.struct((-x["w"]).alias("w"), x["source"].alias("source"), x["text"].alias("text"))))
    known = F.filter(F.transform("o", lambda x: x["confidence"]), lambda c: c.isNotNull())
    held = F.array_sort(F.transform(known, lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))))
    misses = F.aggregate(held, F.lit(1.0), lambda a, c: a * (1 - c))
    order = Window.partitionBy("page_id").orderBy("y0", "x0", "cluster")
    return rows.select(
        "page_id", "cluster", *box, F.col("_kind.kind").alias("kind"), best["text"].alias("chosen_text"), (-F.col("_vote.votes")).cast("long").alias("votes"), F.when(F.size(known) > 0, 1 - misses).alias("confidence"),
        F.size(F.array_distinct(F.transform("o", lambda x: x["source"]))).cast("long").alias("sources"), (F.row_number().over(order) - 1).alias("reading_order"),
    )
