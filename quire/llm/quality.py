"""Quality rules with host verdicts, in DataFrame expressions only.

Rules judge each document; failures are counted by host (``source``), each host's failure rate is shrunk by a
beta prior fitted to all hosts by the method of moments, and hosts whose shrunk rate is too high reject all
their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _runs(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words."""
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))))


def measures(docs: DataFrame, width: int = 5) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) to ``docs``; null text counts as
    empty. Columns of these names are replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    made = docs.withColumns(
        {
            "_words": words,
            "_lines": lines,
            "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        }
    )
    made = made.withColumns({"n_words": F.size("_words").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_runs": _runs(F.col("_words"), width)}).drop("_words", "_lines")
    # Few texts repeat any run; only those are sorted. Sorted with their places, equal runs are neighbours; the
    # places of those are sorted again, and each run covers its words from the end of the run before.
    made = made.withColumn("_some", F.size(F.array_distinct("_runs")) < F.size("_runs"))
    paired = F.when(F.col("_some"), F.array_sort(F.transform(F.col("_runs"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    made = made.withColumn("_sorted", paired).drop("_runs", "_some")
    same = lambda x, j: F.get("_sorted", j)["h"] == x["h"]
    twice = F.filter("_sorted", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
    made = made.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate("_at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")), lambda a, i: F.struct((a["n"] + i + width - F.greatest(i.cast("long"), a["end"])).cast("long").alias("n"), (i + width).cast("long").alias("end")), lambda a: a["n"])
    return made.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failures() -> Column:
    """The host rules: too few words, too much repetition, odd word length, many symbols, many repeated lines."""
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return base_failed() | (mean < 2) | (mean > 15) | (F.col("n_symbols") > 0.1 * F.col("n_words")) | (F.col("n_dup_lines") > 20)


def host_verdicts(judged: DataFrame, keep: Workspace, most: float = 0.5) -> DataFrame:
    """source, n, failed, shrunk and host_kept for every source that is not null.

    With host rates of mean m and variance v (hosts alike), the prior's weight is m(1-m)/v - 1, at least 1 and at
    most 1000 (also where v is 0); a host's shrunk rate is (failed + weight*m) / (n + weight). The two numbers of
    the prior come to the driver, the hosts do not.
    """
    hosts = keep.save(judged.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed")), "counts")
    rate = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = m or 0.0, v or 0.0
    weight = min(max(m * (1 - m) / v - 1, 1.0), 1000.0) if v > 0 else 1000.0
    shrunk = (F.col("failed") + weight * m) / (F.col("n") + weight)
    return hosts.select("source", "n", "failed", shrunk.alias("shrunk"), (shrunk <= most).alias("host_kept"))


def judge(docs: DataFrame, most: float = 0.5, keep: Workspace | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, failed, shrunk (the host's rate) and kept of every row of ``docs`` (doc_id,
    text, source). A null text is empty and fails; a null source has no host verdict; null and repeated doc_ids are
    judged row by row; an empty table gives no rows. Host counts are written before verdicts are joined back, so
    that the planner can split the rows of a hot host."""
    keep = keep or Workspace(docs.sparkSession)
    rows = measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))).drop("text")
    rows = keep.save(rows.withColumns({"base_failed": base_failed(), "failed": rule_failures()}), "judged")
    hosts = host_verdicts(rows, keep, most).select("source", "shrunk", "host_kept")
    out = rows.join(hosts, "source", "left")
    return out.withColumn("shrunk", F.round("shrunk", 9)).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))).drop("source", "host_kept")


def keep_good(docs: DataFrame, most: float = 0.5, keep: Workspace | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each judged for itself, with the columns of ``docs`` as they are.
    Measures are taken once and written with the rows; nulls, empty tables and repeated rows as in judge()."""
    keep = keep or Workspace(docs.sparkSession)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "text", F.col("source").cast("string").alias("source"))
    rows = measures(whole).select("_row", "source", (~base_failed()).alias("passed"), rule_failures().alias("failed"))
    rows = keep.save(rows, "judged")
    hosts = host_verdicts(rows.select("source", "failed"), keep, most).select("source", "host_kept")
    good = rows.where("passed").select("_row", "source").join(hosts, "source", "left").where(F.coalesce("host_kept", F.lit(True)))
    return good.select("_row.*")
