"""Reports over benchmark runs. Failures stay in the denominator; what was not measured stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_scores(results: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """Cases, failures, the mean score with failures as 0, and component means, which are withheld (null) if any case
    failed. A failed case has a null score."""
    failed = F.count_if(F.col("score").isNull())
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), failed.alias("failed"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"), *[F.when(failed == 0, F.avg(c)).alias(f"mean_{c}") for c in components])


def scored_means(results: DataFrame, keys: list[str]) -> DataFrame:
    """As mean_scores, but the mean is over scored cases alone, as recognition benchmarks have it."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count("score").alias("scored"), F.avg("score").alias("mean_score"))


def slices(results: DataFrame, tags: dict[str, Column]) -> DataFrame:
    """One row per case, dimension and value: ``tags`` maps dimensions to array columns. A case counts once for each
    value of each dimension."""
    def named(dimension: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(dimension).alias("dimension"), v.alias("value")))

    pairs = [named(d, c) for d, c in tags.items()]
    return results.withColumn("_tag", F.explode(F.flatten(F.array(*pairs)))).select("*", "_tag.dimension", "_tag.value").drop("_tag")


def comparable_quality(results: DataFrame, keys: list[str]) -> DataFrame:
    """Mean quality where every case is complete and all have one profile, else null; accepted cases and the rate of
    success. Columns: complete, profile, quality, accepted, succeeded."""
    n, done = F.count(F.lit(1)), F.count_if("complete")
    one = F.count_distinct(F.when(F.col("complete"), F.col("profile"))) == 1
    return results.groupBy(*keys).agg(
        n.alias("cases"), done.alias("complete_cases"), F.count_if("accepted").alias("accepted_cases"),
        F.when((n == done) & one, F.sum("quality") / n).alias("mean_quality"), (F.count_if("succeeded") / n).alias("success_rate"),
    )


def nearest_rank(values: str, share: float) -> Column:
    """The value at rank ceil(share * n): one that occurs."""
    return F.expr(f"percentile_disc({share}) within group (order by {values})")


def phase_statistics(phases: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Count, total, mean, nearest-rank p50 and p95, and maximum of each phase."""
    return phases.groupBy(*keys).agg(F.count(seconds).alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), nearest_rank(seconds, 0.5).alias("p50"), nearest_rank(seconds, 0.95).alias("p95"), F.max(seconds).alias("maximum"))


def system_summary(runs: DataFrame, keys: list[str], statuses: list[str]) -> DataFrame:
    """Cases by status, success rate, mean seconds of all and of successful cases, and interpolated p50 and p95 of the
    latter."""
    ok = F.col("status") == "success"
    of_ok = F.when(ok, F.col("seconds"))
    n = F.count(F.lit(1))
    return runs.groupBy(*keys).agg(
        n.alias("cases"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses], (F.count_if(ok) / n).alias("success_rate"),
        F.avg("seconds").alias("mean_seconds"), F.avg(of_ok).alias("mean_seconds_ok"), F.percentile(of_ok, 0.5).alias("p50_seconds_ok"), F.percentile(of_ok, 0.95).alias("p95_seconds_ok"),
    )


def gates(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """Validation in long form: a row per key and gate with passed; a null check did not pass."""
    pairs = [F.struct(F.lit(k).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()]
    return rows.select(*keys, F.inline(F.array(*pairs)))


def gate_scores(long: DataFrame, keys: list[str]) -> DataFrame:
    """Share of gates that passed, and whether all did."""
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("gates"), F.avg(F.col("passed").cast("double")).alias("gate_score"), F.bool_and("passed").alias("accepted"))


def better(candidate: list[Column], current: list[Column]) -> Column:
    """Lexicographic comparison of objectives, smaller first: -1, 0 or 1, as candidate is better, equal or worse."""
    a, b = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(candidate)]), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(current)])
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
