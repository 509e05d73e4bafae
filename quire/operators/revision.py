"""Plans of pages and their revision: placements, constraints, invariants, corrections and bounded passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which archetypes make sheets or slides.
SHEETS, SLIDES = ("spreadsheet", "financial-statement"), ("presentation", "brochure")


def output_format(archetype: Column, requested: Column) -> Column:
    """The requested format, or for ``auto`` the one that suits the archetype."""
    return F.when(requested != "auto", requested).when(archetype.isin(*SHEETS), "xlsx").when(archetype.isin(*SLIDES), "pptx").otherwise("docx")


def planned_elements(elements: DataFrame, page: str, strategy: str = "flow") -> DataFrame:
    """Instructions for elements (page, element_id, reading_order, box, width, height): the box as shares of the page, and the
    order, which for an element without a (positive) hint is its place from 1 among the page's, hints first."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(F.col("reading_order").asc_nulls_last(), "element_id"))
    size = {"x": F.greatest(F.col("width"), F.lit(1.0)), "y": F.greatest(F.col("height"), F.lit(1.0))}
    order = F.when(F.col("reading_order") > 0, F.col("reading_order")).otherwise(place)
    return elements.withColumn("order", order.cast("long")).select(page, "element_id", "order", F.lit(strategy).alias("strategy"), *[(F.col(c) / size[c[0]]).alias(f"n{c}") for c in ("x0", "y0", "x1", "y1")])


def fill_gaps(placements: DataFrame, page: str) -> DataFrame:
    """gap of placements (page, block_index, y0, y1, gap, content_top): where it is unknown, the way down from the placed block
    before, or from the top of the content; none below 0. Blocks without a place keep what they have."""
    w = Window.partitionBy(page).orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.last("y1", True).over(w), F.col("content_top"))
    return placements.withColumn("gap", F.when(F.col("y0").isNotNull(), F.coalesce("gap", F.greatest(F.lit(0.0), F.col("y0") - above))).otherwise(F.col("gap")))


def misplaced_banners(placements: DataFrame, doc: str) -> DataFrame:
    """Banners that belong to the next page. Placements: doc, page, block_index, kind, text, y0, content_top, content_height,
    pages. A banner is the last block of a page but the last, a paragraph or heading of up to 180 characters with a URL, whose
    text (white space and case apart) stands in the document again, in the top 12 % of the content, after a block that ends
    the page with its own folio (``n/total``). Result: doc, block_index, page, to_page."""
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    in_doc = Window.partitionBy(doc).orderBy("block_index")
    folio = r"(?<!\d)(\d{1,4})\s*/\s*(\d{1,4})(?!\d)"
    part = lambda k: F.regexp_extract("_before", folio, k).try_cast("int")
    rows = placements.withColumns({"_before": F.lag("text").over(in_doc), "_at": F.lag("block_index").over(in_doc), "_page": F.lag("page").over(in_doc), "_next": F.lead("page").over(in_doc)})
    link = F.col("text").rlike(r"(?i)https?://|www\.")
    fits = F.col("kind").isin("paragraph", "heading") & (F.length("text") <= 180) & (F.col("page") < F.col("pages")) & (F.col("y0") <= F.col("content_top") + F.round(F.col("content_height") * 0.12))
    fits = fits & (F.col("_at") == F.col("block_index") - 1) & (part(1) == F.col("page")) & (part(2) == F.col("pages")) & ~F.col("_next").eqNullSafe(F.col("page"))
    # A text stands in the document again only among those with a link, and a page goes on only where a run of its blocks begins:
    # no other blocks are sorted again.
    rows = rows.select(doc, "block_index", "page", F.when(link, key).alias("_key"), F.coalesce(link & fits, F.lit(False)).alias("_fits"), (~F.col("_page").eqNullSafe(F.col("page"))).alias("_begins"))
    rows = rows.where("_key is not null or _begins")
    rows = rows.withColumn("_n", F.count("_key").over(Window.partitionBy(doc, "_key"))).where("_begins or (_fits and _n >= 2)")
    last = F.max("block_index").over(Window.partitionBy(doc, "page"))
    return rows.withColumn("_last", last).where("_fits and _n >= 2 and _last = block_index").select(doc, "block_index", "page", (F.col("page") + 1).alias("to_page"))


def structural_roles(blocks: DataFrame, doc: str) -> DataFrame:
    """Roles of blocks (doc, block_index from 0 without gaps, kind, text, starts_group); null for plain ones.

    Headings head a section (a section word or a number) or the document; short texts that end in a colon lead in. Three or
    more blocks in a row that begin ``(n)`` are a quoted passage, with what leads to it and a note in parentheses after it. A
    text with a colon before a group leads to a question. Two or more short paragraphs with a colon right before the first
    section are form fields. A later rule overrules an earlier one."""
    order = Window.partitionBy(doc).orderBy("block_index")
    text, colon = F.col("text"), F.rtrim("text").endswith(":")
    section = text.rlike(r"(?i)^(?:(?:phần|phan|section|part)\s+[\wIVXLCDM.-]+\s*[:.)]|(?:[IVXLCDM]+|\d+)[.)]\s+)")
    rows = blocks.withColumns({"_colon": colon, "_quote": text.rlike(r"^\(\d+\)\s+"), "_section": (F.col("kind") == "heading") & section})
    # Three quoted blocks in a row, this one among them: no window but that of the document's order is needed.
    near = {k: F.coalesce(F.lag("_quote", k).over(order), F.lit(False)) for k in (-2, -1, 1, 2)}
    rows = rows.withColumn("_long", F.col("_quote") & ((near[1] & near[2]) | (near[1] & near[-1]) | (near[-1] & near[-2])))
    rows = rows.withColumns({
        "_before": F.coalesce(F.lag("_long").over(order), F.lit(False)), "_after": F.coalesce(F.lead("_long").over(order), F.lit(False)), "_group": F.coalesce(F.lead("starts_group").over(order), F.lit(False)),
        "_first": F.min(F.when(F.col("_section"), F.col("block_index"))).over(Window.partitionBy(doc)), "_field": (F.col("kind") == "paragraph") & (F.length(F.trim(text)) <= 48) & F.trim(text).endswith(":"),
    })
    # Fields right before the first section: no other block between them and it.
    stop = F.max(F.when(~F.col("_field") & (F.col("block_index") < F.col("_first")), F.col("block_index"))).over(Window.partitionBy(doc))
    form = F.col("_field") & (F.col("block_index") < F.col("_first")) & (F.col("block_index") > F.coalesce(stop, F.lit(-1)))
    rows = rows.withColumn("_form", F.coalesce(form, F.lit(False)))
    rows = rows.withColumn("_form", F.col("_form") & (F.count_if("_form").over(Window.partitionBy(doc)) >= 2))
    role = (
        F.when(F.col("_form"), "form_field")
        .when(F.col("_group") & F.col("_colon"), "question_lead")
        .when(F.col("_before") & ~F.col("_long") & text.startswith("(") & text.endswith(")"), "attribution")
        .when(F.col("_after") & ~F.col("_long") & F.col("_colon"), "passage_lead")
        .when(F.col("_long"), "quoted_passage")
        .when(F.col("kind") == "heading", F.when(F.col("_section"), "section_heading").otherwise("document_heading"))
        .when((F.length(text) <= 90) & F.col("_colon"), "lead_in")
    )
    return rows.withColumn("role", role).select(*blocks.columns, "role")


# The invariants, by the columns that a plan (prefix p_) and an assessment (prefix a_) have.
INVARIANTS: list[tuple[str, str]] = [
    ("authority_hash", "a_content <> p_content or a_layout <> p_layout"),
    ("editability_regression", "current_editability is not null and a_editability < current_editability"),
    ("full_page_raster", "a_raster_pages > 0"),
    ("missing_content", "size(array_except(p_objects, a_objects)) + size(a_missing) + size(a_deleted) > 0"),
    ("object_content", "a_object_content <> p_object_content"),
    ("object_identity", "a_objects <> p_objects"),
    ("object_provenance", "a_object_provenance <> p_object_provenance"),
    ("page_count", "size(a_pages) <> size(p_pages)"),
    ("page_size", "size(a_pages) <> size(p_pages) or exists(arrays_zip(a_pages, p_pages), x -> abs(x.a_pages - x.p_pages) > 1e-6)"),
    ("plan_fingerprint", "a_plan <> p_plan"),
    ("raster_substitution", "size(array_intersect(p_editable, a_substituted)) > 0"),
    ("render_reference", "a_compared <> size(p_pages)"),
    ("required_editability", "size(array_except(p_editable, a_editable)) > 0"),
    ("source_deletion", "size(a_deleted) > 0"),
]


def violations(rows: DataFrame) -> DataFrame:
    """Add violations: the names of all invariants that an assessment breaks, in alphabetical order. An unknown value breaks
    none."""
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(F.expr(rule), name) for name, rule in INVARIANTS])))


def corrected(elements: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of elements (keys, box, width, height, font_size) after one correction each (keys, dx, dy, dw, dh, dfont): the box
    changes its size first, then moves as a whole and is held on the page. Corrections that would leave no box are left out
    and marked as collapsed; font sizes start from 12 where unknown and stay 1 at least."""
    rows = elements.join(corrections.select(*keys, "dx", "dy", "dw", "dh", "dfont", F.lit(True).alias("_there")), keys, "left")
    rows = rows.withColumns({"_w": F.col("x1") - F.col("x0") + F.col("dw"), "_h": F.col("y1") - F.col("y0") + F.col("dh")})
    rows = rows.withColumn("collapsed", F.coalesce(F.col("_there") & ((F.col("_w") <= 0) | (F.col("_h") <= 0)), F.lit(False)))
    rows = rows.withColumn("_do", F.coalesce(F.col("_there") & ~F.col("collapsed"), F.lit(False))).withColumns({"_w": F.least("_w", "width"), "_h": F.least("_h", "height")})
    rows = rows.withColumns({"_x": F.least(F.greatest(F.lit(0.0), F.col("x0") + F.col("dx")), F.col("width") - F.col("_w")), "_y": F.least(F.greatest(F.lit(0.0), F.col("y0") + F.col("dy")), F.col("height") - F.col("_h"))})
    new = {"x0": F.col("_x"), "y0": F.col("_y"), "x1": F.col("_x") + F.col("_w"), "y1": F.col("_y") + F.col("_h")}
    font = F.when(F.col("_do") & (F.col("dfont") != 0), F.greatest(F.lit(1.0), F.coalesce("font_size", F.lit(12.0)) + F.col("dfont"))).otherwise(F.col("font_size"))
    rows = rows.withColumns({**{c: F.when(F.col("_do"), v).otherwise(F.col(c)) for c, v in new.items()}, "font_size": font})
    return rows.select(*elements.columns, "collapsed")


def accepted_passes(passes: DataFrame, keys: list[str], least: float = 0.001) -> DataFrame:
    """Passes (keys, number from 0, score) up to and with the first that gains less than ``least`` on the one before; number 0
    is the score before any. Adds before and accepted."""
    order = Window.partitionBy(*keys).orderBy("number")
    rows = passes.withColumn("before", F.lag("score").over(order)).withColumn("accepted", F.col("score") >= F.col("before") + least)
    lost = F.sum(F.when(F.coalesce("accepted", F.lit(True)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_lost", F.coalesce(lost, F.lit(0))).where("_lost = 0 and number > 0").drop("_lost")


def cached_candidates(requests: DataFrame, plan: str, artifact: str, order: str) -> DataFrame:
    """Add rendered_by: the first request (least ``order``) for the same plan and artifact, whose result the others reuse; a
    request without an artifact stands for itself."""
    first = requests.where(F.col(artifact).isNotNull()).groupBy(plan, artifact).agg(F.min(order).alias("rendered_by"))
    return requests.join(first, [plan, artifact], "left").withColumn("rendered_by", F.coalesce("rendered_by", order))


def equation_units(latex: Column) -> Column:
    """How many lines a display formula takes: 1.62 for each of its rows if anything in it is tall, else 1.18, and 1.25 at
    least. Rows are parted by double backslashes outside braces inside an aligned environment."""
    body = F.regexp_extract(latex, r"(?s)^\s*\\begin\{(aligned|alignedat|gathered|split)\}(?:\{[^{}]*\})?(.*)\\end\{\1\}\s*$", 2)
    # Innermost groups go first, four levels deep, so that only row ends outside of braces are left.
    flat = body
    for _ in range(4):
        flat = F.regexp_replace(flat, r"(?<!\\)\{(?:[^{}\\]|\\.)*(?<!\\)\}", "g")
    parts = F.size(F.filter(F.split(flat, r"\\\\"), lambda x: F.trim(x) != ""))
    rows = F.when(F.length(body) > 0, F.greatest(F.lit(1), parts)).otherwise(1)
    tall = latex.rlike(r"\\(?:frac|dfrac|tfrac|int|sum|prod|sqrt)\b")
    return F.greatest(F.lit(1.25), rows * F.when(tall, 1.62).otherwise(1.18))


def plan_geometry(placements: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """Measures of a plan by page: placements (keys, y0, y1; null without a place) and the source's rows (keys, y0, y1). A source
    row is covered if placed rows overlap it by 90 % of the lesser height. Result: keys, placements, placed, slots, covered and
    span_ratio (the share of the rows' span that placements reach; 1 without rows, 0 without placements)."""
    box, none = F.struct(F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1")), F.lit(None).cast("struct<y0:double,y1:double>")
    both = placements.select(*keys, box.alias("placement"), none.alias("slot")).unionByName(slots.select(*keys, none.alias("placement"), box.alias("slot")))
    return page_geometry(both, keys)


def page_geometry(rows: DataFrame, keys: list[str]) -> DataFrame:
    """plan_geometry() of rows with a placement, a source's row (slot) or both (structs of y0 and y1, else null): a page's are
    gathered by one shuffle at most and held against each other in lists."""
    p, s = F.col("placement"), F.col("slot")
    lists = rows.groupBy(*keys).agg(
        F.count(p).alias("placements"), F.count(p["y0"]).alias("placed"), F.min(p["y0"]).alias("m0"), F.max(p["y1"]).alias("m1"), F.count(s).alias("slots"), F.min(s["y0"]).alias("s0"), F.max(s["y1"]).alias("s1"),
        F.collect_list(F.when(p["y0"].isNotNull(), p)).alias("_p"), F.collect_list(s).alias("_s"),
    )
    shared = lambda a, b: F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    meets = lambda a, b: shared(a, b) / F.greatest(F.lit(1e-9), F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])) >= 0.90
    lists = lists.withColumn("covered", F.size(F.filter("_s", lambda a: F.exists("_p", lambda b: meets(a, b)))).cast("long"))
    reach = F.greatest(F.lit(0.0), F.least("s1", "m1") - F.greatest("s0", "m0"))
    ratio = F.when(F.col("slots") == 0, 1.0).when(F.col("m0").isNull(), 0.0).otherwise(reach / F.greatest(F.lit(1.0), F.col("s1") - F.col("s0")))
    return lists.select(*keys, "placements", "placed", "slots", "covered", ratio.alias("span_ratio"))


def geometry_gates(measures: DataFrame, keys: list[str], coverage: float = 0.85) -> DataFrame:
    """Gates of whole plans over plan_geometry(): rows covered, every placement placed, and the least span of any page with rows.
    Result: keys, name, passed, actual."""
    sums = measures.groupBy(*keys).agg(F.sum("placements").alias("n"), F.sum("placed").alias("p"), F.sum("slots").alias("s"), F.sum("covered").alias("c"), F.coalesce(F.min(F.when(F.col("slots") > 0, F.col("span_ratio"))), F.lit(1.0)).alias("span"))
    share = F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(1.0)
    gate = lambda name, passed, actual: F.struct(F.lit(name).alias("name"), passed.alias("passed"), F.round(actual.cast("double"), 6).alias("actual"))
    gates = F.array(gate("source_visual_slot_coverage", F.round(share, 6) >= coverage, share), gate("source_geometry_placements", F.col("n") == F.col("p"), F.col("p")), gate("mapped_vertical_span", F.round("span", 6) >= 0.95, F.col("span")))
    return sums.select(*keys, F.inline(gates))


def anchor_crossings(placements: DataFrame, keys: list[str], pitch: Column, tolerance: float = 0.30) -> DataFrame:
    """Text placements that cross an image or table of their page: text before it that ends below its top, or after it that
    begins above its bottom, by more than ``tolerance`` line pitches, with 15 % of the narrower width in common. Rows: keys,
    block_index, kind, box. Result: keys, block_index, anchor_index."""
    placed = placements.where("y0 is not null").withColumn("_slack", pitch * tolerance)
    anchors = placed.where(F.col("kind").isin("image", "table")).select(*keys, F.col("block_index").alias("anchor_index"), *[F.col(c).alias(f"{c}2") for c in ("x0", "y0", "x1", "y1")])
    met = placed.where(~F.col("kind").isin("image", "table")).join(anchors, keys)
    across = F.greatest(F.lit(0.0), F.least("x1", "x12") - F.greatest("x0", "x02")) / F.greatest(F.lit(1.0), F.least(F.col("x1") - F.col("x0"), F.col("x12") - F.col("x02")))
    crosses = "(block_index < anchor_index and y1 > y02 + _slack) or (block_index > anchor_index and y0 < y12 - _slack)"
    return met.where(across >= 0.15).where(crosses).select(*keys, "block_index", "anchor_index")


def row_gaps(rows: DataFrame, keys: list[str], pitch: Column, most: float = 1.80) -> DataFrame:
    """The greatest gap between consecutive rows (keys, block_index, y0, y1) of one block, in line pitches, and whether it is at
    most ``most``."""
    order = Window.partitionBy(*keys, "block_index").orderBy("y0", "y1")
    gap = F.greatest(F.lit(0.0), F.col("y0") - F.lag("y1").over(order)) / pitch
    found = rows.withColumn("_gap", F.coalesce(gap, F.lit(0.0))).groupBy(*keys).agg(F.max("_gap").alias("gap"))
    return found.withColumn("passed", F.round("gap", 6) <= most)
