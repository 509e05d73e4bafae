"""Element tables derived from the supplied Parquet tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the lines of each order numbered anew, as the given numbers repeat."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.row_number().over(w))


def document_lines(spark: SparkSession, sf_dir: str, orders: int, part: Column | None = None) -> DataFrame:
    """lines() of documents of several orders: adds doc, block_index (from 1 in each) and, given a condition, position (from 0
    among the lines of the document for which it is as true). Dealt out by document first, one sort numbers them all."""
    rows = table(spark, sf_dir, "lineitem").withColumn("doc", F.floor(F.col("l_orderkey") / orders)).repartition("doc")
    in_order, in_doc = Window.partitionBy("doc", "l_orderkey").orderBy(*ORDER), Window.partitionBy("doc").orderBy("l_orderkey", *ORDER)
    if part is not None:
        so_far = F.count_if(part).over(in_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("position", F.when(part, so_far).otherwise(F.row_number().over(in_doc) - so_far) - 1)
    return rows.withColumns({"_n": F.row_number().over(in_order), "block_index": F.row_number().over(in_doc)}).withColumn("l_linenumber", F.col("_n")).drop("_n")


LINES_SQL = f"lines AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}))::INTEGER AS l_linenumber) FROM lineitem)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a page, a line of it an observed element, the supplier tells the source."""
    at = lines(spark, sf_dir)
    column, row = (F.col("l_linenumber") - 1) % 2, F.floor((F.col("l_linenumber") - 1) / 2)
    x0 = (column * 60 + F.col("l_partkey") % 10).cast("double")
    y0 = (row * 40 + F.col("l_suppkey") % 7).cast("double")
    return at.select(
        F.col("l_orderkey").alias("page_id"),
        F.col("l_linenumber").alias("element_id"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 3).cast("string")).alias("source"),
        F.when(F.col("l_returnflag") == "A", "title").when(F.col("l_returnflag") == "N", "text").otherwise("unknown").alias("kind"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 40 + F.col("l_quantity")).alias("x1"),
        (y0 + 36).alias("y1"),
        F.when(F.col("l_tax") > 0.01, 1 - F.col("l_discount")).alias("confidence"),
        F.concat("l_linestatus", F.lit(" "), (F.col("l_partkey") % 4).cast("string")).alias("text"),
    )


OBS_SQL = f"""{LINES_SQL}, obs AS (SELECT l_orderkey AS page_id, l_linenumber AS element_id, 'src' || (l_suppkey % 3) AS source,
  CASE WHEN l_returnflag = 'A' THEN 'title' WHEN l_returnflag = 'N' THEN 'text' ELSE 'unknown' END AS kind,
  (((l_linenumber - 1) % 2) * 60 + l_partkey % 10)::DOUBLE AS x0, (((l_linenumber - 1) // 2) * 40 + l_suppkey % 7)::DOUBLE AS y0,
  (((l_linenumber - 1) % 2) * 60 + l_partkey % 10)::DOUBLE + 40 + l_quantity AS x1, (((l_linenumber - 1) // 2) * 40 + l_suppkey % 7)::DOUBLE + 36 AS y1,
  CASE WHEN l_tax > 0.01 THEN 1 - l_discount END AS confidence, l_linestatus || ' ' || (l_partkey % 4) AS text FROM lines)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources read each place of a page, nearly alike; on one page in eleven the third reads something else."""
    at = lines(spark, sf_dir)
    slot, n = F.floor((F.col("l_linenumber") - 1) / 3), (F.col("l_linenumber") - 1) % 3
    x0 = (10 + F.col("l_orderkey") % 5).cast("double")
    y0 = (slot * 40 + F.col("l_partkey") % 3).cast("double")
    said = F.concat(F.lit("Line "), slot.cast("string"), F.lit(" of page "), F.col("l_orderkey").cast("string"))
    other = F.when(F.col("l_orderkey") % 11 == 0, "## zz qq ww").when(F.col("l_partkey") % 4 == 0, F.replace(said, F.lit("Line"), F.lit("Lime"))).otherwise(F.replace(said, F.lit(" "), F.lit("  ")))
    return at.select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("element_id"), F.concat(F.lit("src"), n.cast("string")).alias("source"),
        F.when(F.col("l_returnflag") == "A", "title").when(F.col("l_returnflag") == "N", "text").otherwise("unknown").alias("kind"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 60 + F.col("l_suppkey") % 3).alias("x1"), (y0 + 30).alias("y1"),
        F.when(F.col("l_tax") > 0.01, 1 - F.col("l_discount")).alias("confidence"), F.when(n == 0, said).when(n == 1, F.upper(said)).otherwise(other).alias("text"),
    )


READ_SQL = f"""{LINES_SQL}, said AS (SELECT *, (l_linenumber - 1) // 3 AS slot, (l_linenumber - 1) % 3 AS n, 'Line ' || ((l_linenumber - 1) // 3) || ' of page ' || l_orderkey AS said FROM lines),
reads AS (SELECT l_orderkey AS page_id, l_linenumber AS element_id, 'src' || n AS source, CASE WHEN l_returnflag = 'A' THEN 'title' WHEN l_returnflag = 'N' THEN 'text' ELSE 'unknown' END AS kind,
  (10 + l_orderkey % 5)::DOUBLE AS x0, (slot * 40 + l_partkey % 3)::DOUBLE AS y0, (70 + l_orderkey % 5 + l_suppkey % 3)::DOUBLE AS x1, (slot * 40 + l_partkey % 3 + 30)::DOUBLE AS y1, CASE WHEN l_tax > 0.01 THEN 1 - l_discount END AS confidence,
  CASE n WHEN 0 THEN said WHEN 1 THEN upper(said) ELSE CASE WHEN l_orderkey % 11 = 0 THEN '## zz qq ww' WHEN l_partkey % 4 = 0 THEN replace(said, 'Line', 'Lime') ELSE replace(said, ' ', '  ') END END AS text, slot, n = 2 AND l_orderkey % 11 = 0 AS odd FROM said)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a case that a system ran: its type tells the status, its value the seconds and the score."""
    e = table(spark, sf_dir, "events")
    ok = ~F.col("event_type").isin("error")
    return e.select(
        F.concat(F.lit("sys"), (F.col("user_id") % 4).cast("string")).alias("system"),
        F.col("event_id").alias("case_id"),
        F.when(ok, "success").otherwise("crash").alias("status"),
        "event_type",
        F.col("value").alias("seconds"),
        F.when(ok, F.pmod(F.col("event_id") * 37, F.lit(100)) / 100).alias("score"),
        (F.col("event_id") % 10 != 0).alias("complete"),
    )


RUNS_SQL = """runs AS (SELECT 'sys' || (user_id % 4) AS system, event_id AS case_id, CASE WHEN event_type = 'error' THEN 'crash' ELSE 'success' END AS status,
  event_type, value AS seconds, CASE WHEN event_type <> 'error' THEN ((event_id * 37) % 100) / 100 END AS score, event_id % 10 <> 0 AS complete FROM events)"""
