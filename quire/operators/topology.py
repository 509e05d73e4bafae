"""Regions of a page and the edges between them. Every element is in exactly one region of its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

# Which kind of region an element's role or type makes; all others flow in columns.
FLOATING = ("callout", "floating", "sidebar", "text_box", "textbox")
ROLES = {"header": "header", "footer": "footer", "table": "table", "formula": "formula", "equation": "formula", "figure": "figure", "image": "figure", "chart": "figure", "caption": "caption", "footnote": "footnote"}
TYPES = {"header": "header", "footer": "footer", "page_number": "footer", "table": "table", "formula": "formula", "figure": "figure", "image": "figure", "chart": "figure", "caption": "caption", "footnote": "footnote"}
GROUPED = ("header", "footer", "footnote")
BLOCKING = ("table", "formula", "figure", "caption")


def _lookup(values: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def region_kind(kind: Column, role: Column, inferred: Column | None = None) -> Column:
    """What an inferred boundary role says, else the role, else the type; null for elements that flow."""
    said = F.translate(F.lower(F.trim(F.coalesce(role, F.lit("")))), "- ", "__")
    own = F.when(said.isin(*FLOATING), "floating").otherwise(F.coalesce(_lookup(ROLES, said), _lookup(TYPES, kind)))
    return own if inferred is None else F.coalesce(inferred, own)


def reading_order_key() -> list[Column]:
    """Explicit hints first, then the place on the page."""
    return [F.col("reading_order").asc_nulls_last(), F.col("y0"), F.col("x0"), F.col("element_id")]


def column_segments(rows: DataFrame, blocks: Column, page: str) -> DataFrame:
    """Add segment: how many of the page's rows that ``blocks`` is true for have their middle above the element's and share a
    fifth of the narrower width. Each element is held against a list of its page's blockers, so nothing is joined. Rows without
    a page have no blockers."""
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    listed = rows.withColumn("_blockers", F.collect_list(F.when(blocks & F.col(page).isNotNull(), box)).over(Window.partitionBy(page)))
    above = lambda b: (b["y0"] + b["y1"] < F.col("y0") + F.col("y1")) & (g.horizontal_overlap(g.box(), _box(b)) >= 0.20)
    return listed.withColumn("segment", F.size(F.filter("_blockers", above)).cast("long")).drop("_blockers")


def page_regions(elements: DataFrame, page: str) -> DataFrame:
    """Regions of elements (page, element_id, kind, role, column, box): headers, footers and footnotes of a page are one
    region each, other special elements one each, and each column's flow is cut at the special elements that interrupt it.
    Result: page, region_id, region_kind, box, members (ids in order)."""
    known = elements.withColumn("region_kind", region_kind(F.col("kind"), F.col("role")))
    name = F.when(F.col("region_kind").isin(*GROUPED), F.col("region_kind")).otherwise(F.concat_ws(":", "region_kind", F.col("element_id").cast("string")))
    column = F.concat_ws(":", F.lit("column"), F.col("column").cast("string"), F.col("segment").cast("string"))
    rows = column_segments(known, F.col("region_kind").isin(*BLOCKING), page)
    rows = rows.withColumns({"region_id": F.when(F.col("region_kind").isNull(), column).otherwise(name), "region_kind": F.coalesce("region_kind", F.lit("column"))})
    return rows.groupBy(page, "region_id", "region_kind").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_sort(F.collect_list("element_id")).alias("members"))


def _box(x: Column) -> g.Box:
    return tuple(x[c] for c in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


_EDGE = "array<struct<src:string,dst:string,relation:string,confidence:double,reason:string>>"


def _edge(a: Column, b: Column, relation: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(a["region_id"].alias("src"), b["region_id"].alias("dst"), relation.alias("relation"), confidence.alias("confidence"), reason.alias("reason"))


def _edges(regions: DataFrame, page: str, *kinds) -> DataFrame:
    """Edges from each region to those of its page. Each is held against a list of its page's regions, so nothing is joined, and
    what makes the regions is worked out once for all kinds of edges."""
    one = F.struct("region_id", "region_kind", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    rows = regions.where(F.col(page).isNotNull()).select(page, one.alias("a")).withColumn("_all", F.collect_list("a").over(Window.partitionBy(page)))
    others = F.filter("_all", lambda b: b["region_id"] != F.col("a.region_id"))
    found = F.concat(*[kind(F.col("a"), F.col("_others")).cast(_EDGE) for kind in kinds])
    return rows.select(page, "a", F.explode(F.array(others)).alias("_others")).select(page, F.inline(found))


def _semantic(a: Column, others: Column) -> Column:
    kind = a["region_kind"]

    def reason(b: Column) -> Column:
        to = b["region_kind"]
        return F.when((kind == "header") & (to != "header"), "header").when((kind != "footer") & (to == "footer"), "footer").when(~kind.isin(*GROUPED) & (to == "footnote"), "footnote")

    def edge(b: Column) -> Column:
        note = reason(b) == "footnote"
        return _edge(a, b, F.when(note, "footnote").otherwise("page_boundary"), F.when(note, 0.95).otherwise(1.0), F.concat(F.lit("semantic.page_"), reason(b)))

    return F.transform(F.filter(others, lambda b: reason(b).isNotNull()), edge)


def _precedence(a: Column, others: Column) -> Column:
    flows = lambda x: ~x["region_kind"].isin(*GROUPED, "floating")
    p = _box(a)

    def before(b: Column) -> Column:
        q = _box(b)
        higher = (p[1] + p[3] < q[1] + q[3]) | ((p[1] + p[3] == q[1] + q[3]) & (a["region_id"] < b["region_id"]))
        return flows(b) & higher & (g.horizontal_overlap(p, q) >= 0.20) & ~((p[3] > q[1]) & (g.vertical_overlap(p, q) >= 0.20))

    def edge(b: Column) -> Column:
        q = _box(b)
        gap, scale = F.greatest(F.lit(0.0), q[1] - p[3]), F.greatest(p[3] - p[1], q[3] - q[1], F.lit(1.0))
        confidence = F.greatest(F.lit(0.60), F.least(F.lit(0.95), 0.80 + 0.15 * F.least(F.lit(1.0), gap / scale)))
        return _edge(a, b, F.lit("flow"), confidence, F.lit("geometry.vertical_precedence"))

    return F.when(flows(a), F.transform(F.filter(others, before), edge)).otherwise(F.array().cast(_EDGE))


def semantic_edges(regions: DataFrame, page: str) -> DataFrame:
    """Headers come before all other regions and footers after them, footnotes after all but these three. Of two reasons for
    an edge (header to footer) the header's stays. Result: page, src, dst, relation, confidence, reason."""
    return _edges(regions, page, _semantic)


def precedence_edges(regions: DataFrame, page: str) -> DataFrame:
    """Of two regions that share a fifth of the narrower width the one whose middle is higher (ties: the lesser id) comes
    first, unless they overlap by a fifth of the lesser height. Confidence is 0.80 and up to 0.15 more for the gap between
    them, over the greater height. Headers, footers, footnotes and floating regions have no part in it."""
    return _edges(regions, page, _precedence)


def page_edges(regions: DataFrame, page: str) -> DataFrame:
    """Both kinds of edges. They close no cycle: every edge leads forward in one order of the page's regions, headers first, then
    flowing regions by middle and id, then footnotes, then footers (floating ones stand between headers and footnotes and meet no
    flowing one)."""
    return _edges(regions, page, _semantic, _precedence)


def caption_links(captions: DataFrame, figures: DataFrame, page: str) -> DataFrame:
    """The figure of each caption (page, item_id, caption_of, box): the one it names, else one that names it among its
    children, else the nearest with a quarter of the narrower width in common (by distance of the middles down, across, then
    id). Figures: page, target_id, children, box. Result: page, item_id, target_id, confidence, reason; null without any."""
    named = captions.join(figures.select(page, F.col("target_id").alias("caption_of"), F.lit(True).alias("there")), [page, "caption_of"], "left").where("there").select(page, "item_id", F.col("caption_of").alias("named"))
    kids = figures.select(page, "target_id", F.explode("children").alias("item_id")).groupBy(page, "item_id").agg(F.min("target_id").alias("parent"))
    met = captions.join(figures.select(page, "target_id", *[F.col(c).alias(f"{c}2") for c in ("x0", "y0", "x1", "y1")]), page).where(g.horizontal_overlap(g.box(), g.box(suffix="2")) >= 0.25)
    down = F.abs(F.col("y0") + F.col("y1") - F.col("y02") - F.col("y12"))
    across = F.abs(F.col("x0") + F.col("x1") - F.col("x02") - F.col("x12"))
    near = met.groupBy(page, "item_id").agg(F.min_by("target_id", F.struct(down.alias("d"), across.alias("a"), F.col("target_id"))).alias("near"))
    rows = captions.select(page, "item_id").join(named, [page, "item_id"], "left").join(kids, [page, "item_id"], "left").join(near, [page, "item_id"], "left")
    sure = F.col("named").isNotNull() | F.col("parent").isNotNull()
    return rows.select(
        page, "item_id", F.coalesce("named", "parent", "near").alias("target_id"), F.when(sure, 1.0).when(F.col("near").isNotNull(), 0.75).alias("confidence"),
        F.when(F.col("named").isNotNull(), "canonical.relationship.caption_of").when(F.col("parent").isNotNull(), "canonical.relationship.children").when(F.col("near").isNotNull(), "geometry.nearest_figure_caption").alias("reason"),
    )


def hinted_order(rows: DataFrame, page: str) -> DataFrame:
    """Add place (from 0 in each page), by reading_order_key()."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(*reading_order_key())) - 1)
