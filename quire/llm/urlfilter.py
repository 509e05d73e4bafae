"""URL filters in DataFrame expressions only.

Every distinct URL is expanded into host suffixes times path prefixes; expressions and rules meet in an equi-join
on the first 32 bits of their SHA-256, full digests confirm, and the longest rule wins. A rule as common as a top-level
domain would be one hot key: rules are repeated for a few salts, and expressions take the salt of their URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace

SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case) and path (from there up to
    ``?``, ``#`` or the end). Both are empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", keep: Workspace | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    ``rules`` (verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with the rule's
    path. The longest rule (host and path together) wins; at equal length the longer host, then block before allow.
    Where no rule fits, rule is null and the verdict is ``default``. Null and repeated rows are judged row by row; rules
    with a null part are left out; an empty rule table leaves the default; empty pages give no rows.
    """
    keep = keep or Workspace(pages.sparkSession)
    rules = rules.dropna().select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").distinct()
    rules = rules.select("verdict", F.length("host").alias("h"), F.concat("host", "path").alias("rule"), F.length("path").alias("p"), F.size(F.split("host", "[.]")).alias("labels"), F.sha2(F.concat_ws(" ", "host", "path"), 256).alias("digest"))
    rules = keep.save(rules.withColumn("short", F.substring("digest", 1, 8)), "rules")
    # What expressions can meet a rule at all: host depths and path lengths that rules have, both written plainly
    # because there are few (path lengths are bounded by the longest rule).
    said = rules.agg(F.max("labels").alias("labels"), F.array_sort(F.collect_set("p")).alias("lengths")).first()
    labels, lengths = said.labels or 0, said.lengths or []

    host, path = parse(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    urls = rows.select("host", "path").distinct().where("host <> ''")
    # A suffix of k labels, for every k up to the deepest rule.
    suffixes = F.expr(f"transform(sequence(1, least(size(split(host, '[.]')), {max(labels, 1)})), k -> substring_index(host, '.', -k))")
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    expressions = urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    digests = expressions.select("host", "path", F.sha2(F.concat_ws(" ", "suffix", "prefix"), 256).alias("full"), F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    digests = digests.withColumn("short", F.substring("full", 1, 8))
    salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = digests.join(salted, ["short", "salt"]).where("full = digest")
    best = met.groupBy("host", "path").agg(F.max(F.struct((F.col("h") + F.col("p")).alias("size"), "h", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")).alias("best"))
    best = keep.save(best.select("host", "path", "best.rule", "best.verdict"), "verdicts")
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
