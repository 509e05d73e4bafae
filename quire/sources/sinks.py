"""Pages rendered as text, and written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPENS = r"(?m)^(\s{0,3})(#{1,6}(?=\s|$)|[-+*](?=\s)|\d{1,4}[.)](?=\s)|>|```|~~~|-{3,}\s*$|\*{3,}\s*$|_{3,}\s*$|={3,}\s*$)"


def escaped(text: Column) -> Column:
    """A text whose lines open no Markdown block."""
    return F.regexp_replace(text, _OPENS, "$1\\\\$2")


def markdown(elements: DataFrame, document: str, page: str, order: str = "reading_order") -> DataFrame:
    """One Markdown text a document: elements in order, pages parted by a rule. Elements (kind, text, level)."""
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(2))))
    body = escaped(F.coalesce("text", F.lit("")))
    line = F.when(F.col("kind") == "title", F.concat(F.lit("# "), body)).when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), body)).when(F.col("kind") == "list_item", F.concat(F.lit("- "), body)).when(F.col("kind").isin("image", "figure", "chart"), F.concat(F.lit("["), F.col("kind"), F.lit(": "), F.coalesce("text", "kind"), F.lit("]"))).otherwise(body)
    rows = elements.withColumn("_line", line).where("_line <> ''")
    join = lambda c, key, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, c))), lambda x: x[c]), sep)
    pages = rows.groupBy(document, page).agg(join("_line", [order], "\n\n").alias("_page"))
    return pages.groupBy(document).agg(join("_page", [page], "\n\n---\n\n").alias("markdown"))


def documents_json(elements: DataFrame, document: str, page: str, order: str = "reading_order") -> DataFrame:
    """One JSON text a document with its pages and their elements in order; keys are in the order of the columns."""
    inner = [c for c in elements.columns if c not in (document, page)]
    pages = elements.groupBy(document, page).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *[c for c in inner if c != order]))), lambda x: x).alias("elements"))
    return pages.groupBy(document).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col(page), F.col("elements")))).alias("pages"))).alias("json"))


def absolute_html(elements: DataFrame, document: str, page: str) -> DataFrame:
    """One HTML text a page with absolutely placed elements, texts escaped."""
    safe = F.coalesce("text", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    div = F.format_string('<div class="%s" style="left:%.2fpx;top:%.2fpx;width:%.2fpx;height:%.2fpx">%s</div>', F.col("kind"), F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), safe)
    rows = elements.withColumn("_d", div)
    return rows.groupBy(document, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "_d"))), lambda x: x["_d"]), "\n").alias("html"))


def write_cached(rows: DataFrame, folder: str, keys: list[str]) -> None:
    """Write results by key; Spark's commit leaves no half-written table behind."""
    rows.write.mode("overwrite").partitionBy(*keys).parquet(folder)


def misses(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows whose content keys the cache lacks."""
    return wanted.join(cached.select(*keys).distinct(), keys, "left_anti")
