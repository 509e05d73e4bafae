"""Positioned units of sources on scanned pages: which elements count, where they lie, and what tables and regions they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .frames import streamed

# Tolerance of the logarithm of two aspect ratios; kinds that count without text; systems without places.
ASPECT = 0.06
VISUAL = ("image", "figure", "chart", "table", "stamp", "signature")
SYNTHETIC = ("synthetic_reading_order_only", "synthetic", "unknown")


def drop_redundant(elements: DataFrame, page: str) -> DataFrame:
    """Without queries, without cells whose parent is a table, and without words whose parent has text. Rows: page,
    element_id, block_type, parent, kind, text; a parent counts on its own page only."""
    parents = elements.select(page, F.col("element_id").alias("parent"), F.col("kind").alias("_kind"), (F.length(F.coalesce("text", F.lit(""))) > 0).alias("_worded"))
    rows = elements.join(parents, [page, "parent"], "left")
    block = F.upper(F.coalesce("block_type", F.lit("")))
    gone = (block == "QUERY") | (block.isin("CELL", "MERGED_CELL") & (F.col("_kind") == "table")) | ((block == "WORD") & F.col("_worded"))
    return rows.where(~F.coalesce(gone, F.lit(False))).select(*elements.columns)


def projected_box(b: g.Box, width: Column, height: Column, scan_width: Column, scan_height: Column) -> g.Box:
    """A box of a source's page in a scan's pixels (rounded outwards, held within the scan); null where the box is empty on
    the page, or where the two pages differ in aspect by more than the tolerance, unless the source's page is the unit square."""
    unit = (F.abs(width - 1) <= 1e-6) & (F.abs(height - 1) <= 1e-6)
    fits = unit | (F.abs(F.log((width / height) / (scan_width / scan_height))) <= ASPECT)
    held = lambda c, size: F.greatest(F.lit(0.0), F.least(size, c))
    x0, y0, x1, y1 = held(b[0], width), held(b[1], height), held(b[2], width), held(b[3], height)
    ok = (width > 0) & (height > 0) & fits & (x1 > x0) & (y1 > y0)
    left = F.least(scan_width - 1, F.floor(x0 / width * scan_width)).cast("long")
    top = F.least(scan_height - 1, F.floor(y0 / height * scan_height)).cast("long")
    right = F.greatest(left + 1, F.least(scan_width.cast("long"), F.ceil(x1 / width * scan_width))).cast("long")
    bottom = F.greatest(top + 1, F.least(scan_height.cast("long"), F.ceil(y1 / height * scan_height))).cast("long")
    return tuple(F.when(ok, c) for c in (left, top, right, bottom))  # type: ignore[return-value]


def mesh_boxes(rows: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of a photographed page on its rectified one, by the bands of the page's row mesh (the same key columns without
    the last; sy0, sy1, left0, left1, right0, right1, ty0, ty1, target_width). A box takes the extreme points of its parts in
    the bands; one of which less than 98 % of the height lies in bands has none. Result: keys and px0, py0, px1, py1."""
    span = Window.partitionBy(*keys[:-1])
    ends = bands.withColumns({"top": F.min("sy0").over(span), "bottom": F.max("sy1").over(span)})
    met = rows.join(ends, keys[:-1]).withColumns({"c0": F.greatest("y0", "top"), "c1": F.least("y1", "bottom")}).where("c1 > c0")
    met = met.withColumns({"a": F.greatest("c0", "sy0"), "b": F.least("c1", "sy1")}).where("b > a")
    ordered = Window.partitionBy(*keys).orderBy("a", "b")
    before = F.max("b").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("new", F.greatest(F.lit(0.0), F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.col("a")))))
    points = met.withColumn("sy", F.explode(F.array("a", "b"))).withColumn("share", (F.col("sy") - F.col("sy0")) / (F.col("sy1") - F.col("sy0")))
    points = points.withColumns({"left": F.col("left0") + (F.col("left1") - F.col("left0")) * F.col("share"), "right": F.col("right0") + (F.col("right1") - F.col("right0")) * F.col("share")})
    points = points.withColumns({"p0": F.greatest("x0", "left"), "p1": F.least("x1", "right"), "ty": F.col("ty0") + (F.col("ty1") - F.col("ty0")) * F.col("share")})
    at = lambda c: F.when(F.col("p1") > F.col("p0"), (F.col(c) - F.col("left")) / (F.col("right") - F.col("left")) * F.col("target_width"))
    ty = F.when(F.col("p1") > F.col("p0"), F.col("ty"))
    out = points.groupBy(*keys).agg(F.min(at("p0")).alias("px0"), F.min(ty).alias("py0"), F.max(at("p1")).alias("px1"), F.max(ty).alias("py1"), (F.sum("new") / 2).alias("held"), (F.max("c1") - F.min("c0")).alias("tall"))
    return out.where("held >= 0.98 * tall and px0 is not null").drop("held", "tall")


def evidence_units(elements: DataFrame, page: str, doc: str) -> DataFrame:
    """Units of a source: elements (doc, page, element_id, reading_order, kind, text, system, box, width, height, scan_width,
    scan_height, confidence) with a place and with text or visual, projected into the scan, and their positions from 0 in
    the document by page and reading order (unknown ones in place of their ids). Adds clipped: whether the box left its page."""
    rows = elements.where(~F.coalesce("system", F.lit("")).isin(*SYNTHETIC))
    rows = rows.where((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) | F.col("kind").isin(*VISUAL))
    px = projected_box(g.box(), F.col("width"), F.col("height"), F.col("scan_width"), F.col("scan_height"))
    rows = rows.withColumns(dict(zip(("px0", "py0", "px1", "py1"), px, strict=True))).where("px0 is not null")
    rows = rows.withColumn("clipped", (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > F.col("width")) | (F.col("y1") > F.col("height")))
    order = Window.partitionBy(doc).orderBy(page, F.col("reading_order").isNull(), F.coalesce("reading_order", "element_id"), "element_id")
    return rows.withColumn("position", F.row_number().over(order) - 1)


def table_regions(regions: DataFrame, images: DataFrame, page: str) -> DataFrame:
    """Regions (page, region_id, box, horizontal_rules, vertical_rules) that can hold a table: some vertical rule, two
    horizontal or three vertical ones, and no image over 55 % of the smaller area."""
    ruled = regions.where("vertical_rules > 0 and (horizontal_rules >= 2 or vertical_rules >= 3)")
    other = images.select(page, *[F.col(c).alias(f"{c}2") for c in ("x0", "y0", "x1", "y1")])
    a, b = g.box(), g.box(suffix="2")
    hidden = ruled.join(other, page).where(g.overlap(a, b) / F.greatest(F.lit(1.0), F.least(g.area(a), g.area(b))) >= 0.55).select(page, "region_id").distinct()
    return ruled.join(hidden, [page, "region_id"], "left_anti")


def match_tables(tables: DataFrame, regions: DataFrame, doc: str) -> DataFrame:
    """Tables of a text (doc, block_index, rows, columns, group_id) with ruled regions (doc, place, horizontal_rules,
    vertical_rules, aspect), both in order: a table takes the next region with rules enough, or shares the wide region before
    it with its neighbour of the same group. Result: doc, block_index, place, confidence."""
    kinds = dict(tables.dtypes)
    nothing = lambda c, k: F.lit(None).cast(k).alias(c)
    left = tables.select(doc, F.lit(0).alias("side"), F.col("block_index").cast("long").alias("at"), F.col("rows").cast("long").alias("p"), F.col("columns").cast("long").alias("q"), F.col("group_id").cast("string").alias("grp"), nothing("aspect", "double"))
    right = regions.select(doc, F.lit(1).alias("side"), F.col("place").cast("long").alias("at"), F.col("horizontal_rules").cast("long").alias("p"), F.col("vertical_rules").cast("long").alias("q"), nothing("grp", "string"), F.col("aspect").cast("double").alias("aspect"))

    def work(at, rows):
        wanted = sorted(r[2:6] for r in rows if r[1] == 0)
        ruled = sorted((r[2], r[3], r[4], r[6]) for r in rows if r[1] == 1)
        out, k, group, wide = [], 0, None, 0
        for block, n_rows, n_columns, own in wanted:
            least_down, least_across = max(2, -(-45 * (n_columns + 1) // 100)), 2 if n_rows >= 2 else 1
            k = next((i for i in range(k, len(ruled)) if ruled[i][2] >= least_down and ruled[i][1] >= least_across), len(ruled))
            if k == len(ruled):
                break
            last = ruled[k - 1] if k else None
            shares = last is not None and own is not None and own == group and last[3] >= 4.5 and last[2] >= max(n_columns, wide) + 1
            chosen = last if shares else ruled[k]
            k += not shares
            by_row = 0.65 if chosen[1] == 0 else 1 / (1 + abs(chosen[1] - n_rows - 1))
            by_column = 1 / (1 + abs(chosen[2] - n_columns - 1))
            out.append((at, block, chosen[0], max(0.35, min(0.92, 0.45 + 0.22 * by_row + 0.25 * by_column))))
            group, wide = own, n_columns
        return out

    return streamed(left.unionByName(right), doc, work, f"{doc} {kinds[doc]}, block_index long, place long, confidence double")


def merge_detections(parsed: DataFrame, detections: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """Parsed blocks with the score of an equivalent detection (same kind, IoU of 0.98 or more; the least detection_id), whose
    confidence they take if they have none; and the detections that are equivalent to no block."""
    other = detections.select(page, "kind", F.col("detection_id"), F.col("confidence").alias("layout_confidence"), *[F.col(c).alias(f"{c}2") for c in ("x0", "y0", "x1", "y1")])
    met = parsed.select(page, "kind", "block_id", "x0", "y0", "x1", "y1").join(other, [page, "kind"]).where(g.iou(g.box(), g.box(suffix="2")) >= 0.98)
    # A detection goes to its first block, and a block keeps the score of its last detection.
    first = met.groupBy(page, "detection_id").agg(F.min("block_id").alias("block_id"), F.min("layout_confidence").alias("layout_confidence"))
    own = first.groupBy(page, "block_id").agg(F.max_by("layout_confidence", "detection_id").alias("layout_confidence"), F.min_by("layout_confidence", F.when(F.col("layout_confidence").isNotNull(), F.col("detection_id"))).alias("_first"))
    blocks = parsed.join(own, [page, "block_id"], "left").withColumn("confidence", F.coalesce("confidence", "_first")).drop("_first")
    return blocks, detections.join(first.select(page, "detection_id"), [page, "detection_id"], "left_anti")


def merged_rows(boxes: DataFrame, page: str, by_middle: Column | None = None) -> DataFrame:
    """Rows of boxes (page, box), folded from the top: a box joins the row before if they overlap by 0.55 of the lesser height
    or, with ``by_middle`` (a tolerance), if their middles are at most that far apart. Result: page, row, box, n."""
    kinds = dict(boxes.dtypes)
    near = by_middle is not None
    plain = boxes.select(page, *[F.col(c).cast("double").alias(c) for c in ("y0", "x0", "y1", "x1")], (by_middle if near else F.lit(0.0)).cast("double").alias("tolerance"))

    def work(at, rows):
        out: list = []
        for _, y0, x0, y1, x1, tolerance in sorted(rows):
            last = out[-1] if out else None
            if last and near:
                joins = abs((y0 + y1) - (last[1] + last[3])) / 2 <= tolerance
            elif last:
                joins = max(0.0, min(y1, last[3]) - max(y0, last[1])) / max(1.0, min(y1 - y0, last[3] - last[1])) >= 0.55
            if last and joins:
                out[-1] = (min(x0, last[0]), min(y0, last[1]), max(x1, last[2]), max(y1, last[3]), last[4] + 1)
            else:
                out.append((x0, y0, x1, y1, 1))
        return [(at, k, *r) for k, r in enumerate(out)]

    return streamed(plain, page, work, f"{page} {kinds[page]}, row long, x0 double, y0 double, x1 double, y1 double, n long")
