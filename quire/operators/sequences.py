"""Order and runs within pages, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reading_order(rows: DataFrame, page: str, width: Column, element: str = "element_id") -> DataFrame:
    """Add reading_order from 1. Wide elements (0.62 of the page, or across its middle) are full; with two or more
    elements on either side the order is: full ones above both columns, left, right, the other full ones; else
    from top to bottom. Within a group by y0, x0, then the element's id."""
    w = Window.partitionBy(page)
    full = ((F.col("x1") - F.col("x0")) >= 0.62 * width) | ((F.col("x0") < width / 2) & (F.col("x1") > width / 2))
    side = F.when(full, "full").when((F.col("x0") + F.col("x1")) / 2 < width / 2, "left").otherwise("right")
    rows = rows.withColumn("_side", side)
    rows = rows.withColumns({
        "_two": (F.count_if(F.col("_side") == "left").over(w) >= 2) & (F.count_if(F.col("_side") == "right").over(w) >= 2),
        "_top": F.min(F.when(F.col("_side") != "full", F.col("y0"))).over(w),
    })
    group = F.when(~F.col("_two"), 0).when((F.col("_side") == "full") & (F.col("y0") <= F.col("_top")), 0).when(F.col("_side") == "left", 1).when(F.col("_side") == "right", 2).otherwise(3)
    order = Window.partitionBy(page).orderBy("_group", "y0", "x0", element)
    return rows.withColumn("_group", group).withColumn("reading_order", F.row_number().over(order)).drop("_side", "_two", "_top", "_group")


def concordance(pairs: DataFrame, page: str, reference: str, candidate: str) -> DataFrame:
    """Per page the share of pairs of elements that both orders rank alike; 1 with fewer than two elements. Ties in the
    candidate's order count against it. A page's elements meet each other, as pages are small."""
    a = pairs.select(page, F.col(reference).alias("r1"), F.col(candidate).alias("c1"))
    b = pairs.select(page, F.col(reference).alias("r2"), F.col(candidate).alias("c2"))
    met = a.join(b, page).where("r1 < r2").groupBy(page).agg((F.count_if(F.col("c1") < F.col("c2")) / F.count(F.lit(1))).alias("order_accuracy"))
    return pairs.select(page).distinct().join(met, page, "left").select(page, F.coalesce("order_accuracy", F.lit(1.0)).alias("order_accuracy"))


def boundary_roles(rows: DataFrame, document: str, page: str, relative_y: Column, text: str = "text") -> DataFrame:
    """Elements in the top or bottom tenth of a page whose text stands there on at least half of the document's pages,
    and on two at least: role header or footer. Text is compared with white space collapsed and in lower case."""
    key = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    role = F.when(relative_y <= 0.1, "header").when(relative_y >= 0.9, "footer")
    rows = rows.withColumns({"_key": key, "role": role})
    pages = rows.groupBy(document).agg(F.count_distinct(page).alias("_pages"))
    seen = rows.where("role is not null and _key <> ''").groupBy(document, "_key", "role").agg(F.count_distinct(page).alias("_on"))
    common = seen.join(pages, document).where((F.col("_pages") >= 2) & (F.col("_on") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") / 2)))).select(document, "_key", "role")
    return rows.join(common, [document, "_key", "role"], "left_semi").drop("_key")


def merged_runs(rows: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Intervals of a key merged where the next begins at most ``gap`` after the greatest end so far."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.min(start).alias("run_start"), F.max(end).alias("run_end"), F.count(F.lit(1)).alias("n"))


def flow_lines(rows: DataFrame, page: str, share: float = 0.55, element: str = "element_id") -> DataFrame:
    """Number spans of a page into lines: in order of y0 a span continues the line of the span before it if they share
    ``share`` of the lesser height. Adds line (from 1)."""
    w = Window.partitionBy(page).orderBy("y0", "x0", element)
    top, bottom = F.lag("y0").over(w), F.lag("y1").over(w)
    shared = F.least("y1", bottom) - F.greatest("y0", top)
    same = shared >= share * F.least(F.col("y1") - F.col("y0"), bottom - top)
    return rows.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def dominant_gap(rows: DataFrame, keys: list[str], position: str, share: float = 0.08, least: float = 2.25) -> DataFrame:
    """The gap between neighbours that most gaps of a key lie near (within ``share`` of it or ``least``): gaps are counted
    around each distinct one by a range window; ties go to the smaller. Adds near and n."""
    w = Window.partitionBy(*keys).orderBy(position)
    gaps = rows.select(*keys, (F.lead(position).over(w) - F.col(position)).alias("gap")).where("gap > 0")
    counts = gaps.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("c"))
    span = F.greatest(F.col("gap") * share, F.lit(least))
    around = counts.join(counts.select(*keys, F.col("gap").alias("g2"), F.col("c").alias("c2")), keys).where(F.abs(F.col("gap") - F.col("g2")) <= span)
    near = around.groupBy(*keys, "gap").agg(F.sum("c2").alias("near"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    best = near.groupBy(*keys).agg(F.max_by("gap", F.struct("near", (-F.col("gap")).alias("g"))).alias("gap"), F.max("near").alias("near"))
    return best.join(total, keys).where(F.col("near") * 2 > F.col("n"))


def carried_label(rows: DataFrame, keys: list[str], order: str, label: str, resets: Column) -> DataFrame:
    """The last label before or at each row within its section; a row that ``resets`` begins a section."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum(F.when(resets, 1).otherwise(0)).over(w))
    return rows.withColumn("group_label", F.last(label, ignorenulls=True).over(Window.partitionBy(*keys, "section").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def spans(rows: DataFrame, page: str | list[str], order: str, text: str, longest: int = 8) -> DataFrame:
    """All runs of up to ``longest`` neighbouring texts of a page (named by a column or several), joined by a space: first, size
    and span_text."""
    keys = [page] if isinstance(page, str) else page
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, longest - 1)
    ahead = rows.select(*keys, F.col(order).alias("first"), F.collect_list(text).over(w).alias("_t"))
    sizes = ahead.select(*keys, "first", "_t", F.explode(F.sequence(F.lit(1), F.size("_t"))).alias("size"))
    return sizes.select(*keys, "first", "size", F.array_join(F.slice("_t", 1, F.col("size")), " ").alias("span_text"))


def anchors(blocks: DataFrame, found: DataFrame, key: str, place: str) -> DataFrame:
    """Blocks whose key occurs once among the blocks and once among the places: what later matches may be bound by."""
    one = lambda d, c: d.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(c).alias(c)).where("_n = 1").drop("_n")
    return one(blocks, "block_id").join(one(found, place), key)


def numbered(rows: DataFrame, document: str, page: str, element: str = "element_id") -> DataFrame:
    """Add place (from 0 in the page: by reading_order, unknown ones last, then as the source has them) and ordinal (from 0 in
    the document, as the source has them)."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(F.col("reading_order").asc_nulls_last(), element)) - 1
    ordinal = F.row_number().over(Window.partitionBy(document).orderBy(page, element)) - 1
    return rows.withColumns({"place": place.cast("long"), "ordinal": ordinal.cast("long")})


def smoothed(rows: DataFrame, keys: list[str], order: str, value: str, reach: int, name: str) -> DataFrame:
    """Add the mean of a value over up to ``reach`` rows before and after each."""
    return rows.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)))
