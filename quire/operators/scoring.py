"""Composite scores, run records and checks of benchmark cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

COMPONENTS = ("text", "layout", "structure", "editability", "visual")


def structure_score(type_f1: Column, order: Column, hierarchy: Column, table: Column) -> Column:
    """0.40 of the types' F1, 0.25 of reading order, 0.20 of hierarchy and 0.15 of tables, held within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.40 * type_f1 + 0.25 * order + 0.20 * hierarchy + 0.15 * table))


def structure_metrics(types: DataFrame, order: DataFrame, hierarchy: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """One row a case with type_f1, order_accuracy, relationship_accuracy, table_accuracy and structure_score. A case that a
    part says nothing of has 1 there, as nothing in it could be wrong."""
    rows = types.select(*keys, "type_f1").join(order.select(*keys, "order_accuracy"), keys, "full").join(hierarchy.select(*keys, "relationship_accuracy"), keys, "full").join(tables.select(*keys, "table_accuracy"), keys, "full")
    parts = ["type_f1", "order_accuracy", "relationship_accuracy", "table_accuracy"]
    rows = rows.select(*keys, *[F.coalesce(c, F.lit(1.0)).alias(c) for c in parts])
    return rows.withColumn("structure_score", structure_score(*[F.col(c) for c in parts]))


def accepted(rows: DataFrame) -> DataFrame:
    """Add measured (how many components have a value) and accepted: all are measured and exactly 1."""
    known = sum((F.col(c).isNotNull().cast("int") for c in COMPONENTS), F.lit(0))
    exact = F.lit(True)
    for c in COMPONENTS:
        exact = exact & F.coalesce(F.col(c) == 1.0, F.lit(False))
    return rows.withColumns({"measured": known, "accepted": exact})


def page_texts(rows: DataFrame, doc: str, page: str) -> DataFrame:
    """The text of documents: elements with text in reading order (unknown ones last, then by place in the source) joined by
    new lines, pages by form feeds. A document's text is one value, as large as the document."""
    place = F.struct(F.col("reading_order").isNull().alias("n"), F.coalesce("reading_order", F.lit(0)).alias("o"), F.col("position"), F.col("text"))
    worded = F.when(F.coalesce(F.col("text"), F.lit("")) != "", place)
    lines = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["text"]), "\n")
    pages = rows.groupBy(doc, page).agg(lines(F.collect_list(worded)).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "t"))), lambda x: x["t"]), "\f")
    return pages.groupBy(doc).agg(joined.alias("document_text"))


def case_fingerprints(cases: DataFrame, *columns: str) -> Column:
    """A digest of a case's identity: the columns in alphabetical order as a JSON object."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in sorted(columns)])), 256)


def pending(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Cases (case_id, fingerprint) to run again: those without a record of the same fingerprint, and those whose record says
    success while its output (recorded_sha) differs from what is there (output_sha)."""
    good = records.where("not succeeded or recorded_sha <=> output_sha").select("case_id", "fingerprint")
    return cases.join(good, ["case_id", "fingerprint"], "left_anti")


def run_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases with their results (case_id, score, error), failures included: a case without a result or with an error has no
    score, an error's text, and for its fingerprint the digest of its id."""
    rows = cases.join(results, "case_id", "left")
    failed = F.col("error").isNotNull() | F.col("score").isNull()
    return rows.withColumns({
        "fingerprint": F.when(failed, F.sha2(F.col("case_id").cast("string"), 256)).otherwise(F.col("fingerprint")),
        "error": F.when(failed, F.coalesce("error", F.lit("no result"))),
        "score": F.when(~failed, F.col("score")),
    })


# What an error output says of memory and of crashes.
OUT_OF_MEMORY = r"(?i)(?:out of (?:host |device )?memory|cuda out of memory|memoryerror|cannot allocate memory|allocation failed|oom(?:-killer| killed)?)"
CRASHED = r"(?i)(?:segmentation fault|access violation|core dumped|bus error|fatal signal)"


def failure_status(timed_out: Column, exit_code: Column, stderr: Column) -> Column:
    """Why a run failed: timeout, out of memory (killed, or so it says), crash (a signal, or so it says), else a bad exit."""
    said = F.coalesce(stderr, F.lit(""))
    oom = exit_code.isin(137, -9) | said.rlike(OUT_OF_MEMORY)
    return F.when(timed_out, "timeout").when(F.coalesce(oom, said.rlike(OUT_OF_MEMORY)), "oom").when(F.coalesce((exit_code < 0) | said.rlike(CRASHED), F.lit(False)) & exit_code.isNotNull(), "crash").otherwise("nonzero_exit")


def annotation_faults(rows: DataFrame, page: str) -> DataFrame:
    """Add fault to annotations (page, index, anno_id, ignored, order): the first rule that one breaks, else null. Ids must be
    there and unique, ignored must be stated, orders must not be negative and be unique; of equal ones the first is right."""
    earlier = lambda c: F.row_number().over(Window.partitionBy(page, c).orderBy("index")) > 1
    fault = (
        F.when(F.length(F.trim(F.coalesce("anno_id", F.lit("")))) == 0, "invalid_annotation_id").when(earlier("anno_id"), "duplicate_annotation_id")
        .when(F.col("ignored").isNull(), "invalid_ignore_flag").when(F.col("order") < 0, "invalid_reading_order").when(F.col("order").isNotNull() & earlier("order"), "duplicate_reading_order")
    )
    return rows.withColumn("fault", fault)


def projection_checks(pages: DataFrame, annotations: DataFrame, page: str) -> DataFrame:
    """Whether annotations fit their raster: pages (page, width, height as reported, raster_width, raster_height) and
    annotations (page, ignored, box). reason is dimensions_match, reported_dimensions_transposed (these are corrected), or why
    not: reported_dimensions_incompatible, annotation_out_of_bounds (beyond the greater of a pixel and 0.2 % of the longer side)."""
    found = annotations.groupBy(page).agg(F.count_if(~F.col("ignored")).alias("retained"), F.count_if("ignored").alias("ignored"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    rows = pages.join(found, page, "left").na.fill(0, ["retained", "ignored", "x0", "y0", "x1", "y1"])
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.5
    slack = F.greatest(F.lit(1.0), 0.002 * F.greatest("raster_width", "raster_height"))
    outside = (F.col("x0") < -slack) | (F.col("y0") < -slack) | (F.col("x1") > F.col("raster_width") + slack) | (F.col("y1") > F.col("raster_height") + slack)
    same, turned = near("width", "raster_width") & near("height", "raster_height"), near("width", "raster_height") & near("height", "raster_width")
    reason = F.when(~same & ~turned, "reported_dimensions_incompatible").when(outside, "annotation_out_of_bounds").when(same, "dimensions_match").otherwise("reported_dimensions_transposed")
    return rows.select(page, "retained", "ignored", reason.alias("reason"), (~same & turned).alias("corrected"))


def component_costs(pairs: DataFrame) -> DataFrame:
    """Pairs of components (ids, ids2, shape, area, position, overlap) that may be matched, and what that costs: those that
    share an object, that are alike (0.55, 0.50 and 0.65), or that overlap (0.35 each). 1 less 0.50, 0.30 and 0.20 of shape,
    area and position."""
    alike = (F.col("shape") >= 0.55) & (F.col("area") >= 0.50) & (F.col("position") >= 0.65)
    lies = (F.col("overlap") >= 0.35) & (F.col("shape") >= 0.35) & (F.col("area") >= 0.35)
    some = pairs.where(F.arrays_overlap("ids", "ids2") | alike | lies)
    return some.withColumn("cost", F.greatest(F.lit(0.0), 1 - (0.50 * F.col("shape") + 0.30 * F.col("area") + 0.20 * F.col("position"))))


def object_ids(components: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """Objects of each component (page, component_id, box): the regions (page, object_id, box) that share a tenth of the smaller
    area with it, by name without case. Components without one have an empty list."""
    a, b = g.box(), g.box(suffix="2")
    other = regions.select(page, "object_id", *[F.col(c).alias(f"{c}2") for c in ("x0", "y0", "x1", "y1")])
    met = components.join(other, page).where(g.overlap(a, b) > 0).where(g.overlap(a, b) / F.least(g.area(a), g.area(b)) >= 0.10)
    found = met.groupBy(page, "component_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.lower("object_id").alias("k"), F.col("object_id")))), lambda x: x["object_id"]).alias("objects"))
    return components.join(found, [page, "component_id"], "left").withColumn("objects", F.coalesce("objects", F.array().cast("array<string>")))


def render_diagnostics(pairs: DataFrame) -> DataFrame:
    """What is wrong with matched components: rows with has_ids, shape, area, position, overlap, dx, dy (shares of the page),
    width_ratio, height_ratio, missing and extra (shares of ink). A region is displaced (0.008 or more), of another size (a
    ratio under 0.80), or else lacks or adds ink (0.15 or more, missing first). Adds kind and severity, a row for each."""
    moved = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    displaced = (moved >= 0.008) & ((F.col("shape") >= 0.45) | F.col("has_ids"))
    resized = (F.least("width_ratio", "height_ratio", "area") < 0.80) & ((F.col("shape") >= 0.40) | F.col("has_ids"))
    item = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), severity)).alias("severity"))
    found = F.array(
        F.when(displaced, item("displaced_region", 0.65 * F.least(F.lit(1.0), moved / 0.20) + 0.35 * (1 - F.col("overlap")))),
        F.when(resized, item("size_mismatch", 1 - (0.45 * F.col("area") + 0.30 * F.col("width_ratio") + 0.25 * F.col("height_ratio")))),
        F.when(~displaced & ~resized & (F.col("missing") >= 0.15), item("missing_region", 0.15 + 0.85 * F.sqrt("missing"))),
        F.when(~displaced & ~resized & (F.col("missing") < 0.15) & (F.col("extra") >= 0.15), item("extra_region", 0.15 + 0.85 * F.sqrt("extra"))),
    )
    return pairs.withColumn("_found", F.explode(F.array_compact(found))).select(*pairs.columns, "_found.kind", "_found.severity")


def first_difference(expected: Column, actual: Column) -> Column:
    """The place (from 0) of the first character in which two texts differ; null for equal ones. Texts are compared in the JVM,
    character by character up to the shorter one's end."""
    n = F.least(F.length(expected), F.length(actual))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(expected, i, F.lit(1)) != F.substring(actual, i, F.lit(1)))
    return F.when(expected == actual, None).when(n == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n))
