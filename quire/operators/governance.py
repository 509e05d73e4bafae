"""Dataset governance: splits, leakage, duplicates and rights.

Samples are rows of sample_id, group_id, digest, and what else a rule names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import split_of


def assign_splits(samples: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``split``; a stated one in column ``stated_split`` wins if there is such a column."""
    stated = F.col("stated_split") if "stated_split" in samples.columns else None
    return samples.withColumn("split", split_of(F.col("group_id"), seed, stated))


def duplicate_digests(samples: DataFrame) -> DataFrame:
    """digest, copies and sample_id of every sample whose digest others have too: a row a copy, so that a digest of any number
    of copies is spread over rows."""
    known = samples.where(F.col("digest").isNotNull())
    many = known.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return known.select("digest", "sample_id").join(many, "digest").select("digest", "copies", "sample_id")


def leakage(samples: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` whose samples fall into more than one split."""
    found = samples.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_samples"))
    return found.where("n_splits > 1")


def rights_error(lane: Column, wanted: str, commercial: Column, license_id: Column, pii: Column, consent: Column) -> Column:
    """Why a sample may not be used in the wanted lane; null if it may."""
    unknown = F.when(lane == "unknown", "usage lane is unknown")
    private = F.when(F.lower(pii).isin("contains-pii", "pii", "secret") & (F.coalesce(consent, F.lit("")) == ""), "personal data without consent scope")
    if wanted != "commercial-permissive":
        return F.coalesce(unknown, private)
    excluded = F.when(lane != "commercial-permissive", "excluded from commercial training")
    unclear = F.when(~F.coalesce(commercial, F.lit(False)) | (F.coalesce(license_id, F.lit("")) == ""), "commercial rights are not explicit")
    return F.coalesce(unknown, excluded, unclear, private)


def audit(samples: DataFrame, slices: list[str]) -> DataFrame:
    """Per split and slice: samples, labelled ones, those whose digest others share, and those whose digest leaks into
    another split. One shuffle by digest, one by slice; a digest's rows need not meet, as counts come by a join of
    partial sums."""
    by = samples.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("split").alias("splits")).where("copies > 1")
    rows = samples.join(by, "digest", "left")
    return rows.groupBy("split", *slices).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count("label").alias("n_labelled"),
        F.count_if(F.col("copies") > 1).alias("n_duplicate"),
        F.count_if(F.col("splits") > 1).alias("n_leaking"),
    )


def shard_cases(cases: DataFrame, order: str, index: int, count: int) -> DataFrame:
    """Every ``count``-th case in order from ``index``. Positions are counted range by range: a range sort, then a sum
    of the sizes of the ranges before (a row a range), so no task sees all rows."""
    ranged = cases.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    sizes = {r._part: r.n for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, total = [], 0
    for part in sorted(sizes):
        base += [F.lit(part), F.lit(total)]
        total += sizes[part]
    before = F.create_map(*base)[F.col("_part")] if base else F.lit(0)
    return ranged.withColumn("ordinal", (before + F.col("_local")).cast("long")).where(F.col("ordinal") % count == index).drop("_part", "_local")
