"""Frames, canonical order and the reducers that follow it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import OBS_SQL, observations
from ..operators import frames, matching
from ..registry import query


def framed(spark, sf_dir):
    """Observations of three engines, each in a frame of its own."""
    n = F.substring("source", 4, 1).cast("int")
    k = (n + 1).cast("double")
    return observations(spark, sf_dir).withColumns({
        "engine": F.when(n == 0, "paddleocr").when(n == 1, "Custom").otherwise("native_pdf"),
        "source_type": F.when((n == 2) & (F.col("page_id") % 3 == 0), "native").when(n == 1, "image").otherwise("scanned"),
        "width": k * 160, "height": k * 200, "reading_order": F.when(F.col("element_id") % 2 == 0, F.col("element_id")),
        **{c: F.col(c) * k for c in ("x0", "y0", "x1", "y1")},
    })


FRAMED = f"""{OBS_SQL}, framed AS (SELECT page_id, element_id, source, kind, confidence, text, x0 * k AS x0, y0 * k AS y0, x1 * k AS x1, y1 * k AS y1,
  CASE k WHEN 1 THEN 'paddleocr' WHEN 2 THEN 'Custom' ELSE 'native_pdf' END AS engine, CASE WHEN k = 3 AND page_id % 3 = 0 THEN 'native' WHEN k = 2 THEN 'image' ELSE 'scanned' END AS source_type,
  k * 160 AS width, k * 200 AS height, CASE WHEN element_id % 2 = 0 THEN element_id END AS reading_order FROM (SELECT *, substr(source, 4, 1)::DOUBLE + 1 AS k FROM obs))"""
PICKED = f"""{FRAMED}, sums AS (SELECT page_id, source, min(source_type) AS st, min(width) AS w, min(height) AS h, round(sum(coalesce(confidence, 0)), 9) AS sure FROM framed GROUP BY 1, 2),
picked AS (SELECT page_id, source AS frame_source, w AS frame_width, h AS frame_height FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY st <> 'native', -sure, source) AS n FROM sums) WHERE n = 1)"""
KEY = "CASE lower(engine) WHEN 'paddleocr' THEN 0 WHEN 'native_pdf' THEN 9 ELSE 11 END, lower(engine), source, reading_order NULLS LAST, y0, x0, y1, x1, kind, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), element_id"


@query(f"WITH {PICKED} SELECT * FROM picked")
def reference_frames(spark, sf_dir):
    return frames.reference_frames(framed(spark, sf_dir), "page_id")


@query(f"""WITH {PICKED}, m AS (SELECT f.*, frame_width / width AS a, frame_height / height AS d FROM framed f JOIN picked USING (page_id)), s AS (SELECT *, NOT (abs(a - 1) <= 1e-3 AND abs(d - 1) <= 1e-3) AS rescaled FROM m)
SELECT page_id, element_id, rescaled, {", ".join(f"round(CASE WHEN rescaled THEN {c} * {s} ELSE {c} END, 6) AS {c}" for c, s in (("x0", "a"), ("y0", "d"), ("x1", "a"), ("y1", "d")))}, round(CASE WHEN rescaled THEN 10 * a ELSE 10 END, 6) AS font_size FROM s""")
def rescaled_boxes(spark, sf_dir):
    out = frames.rescaled(framed(spark, sf_dir).withColumn("font_size", F.lit(10.0)), "page_id", ("font_size",))
    return out.select("page_id", "element_id", "rescaled", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "font_size")])


@query(f"WITH {FRAMED} SELECT page_id, element_id, row_number() OVER (PARTITION BY page_id ORDER BY {KEY}) - 1 AS canonical FROM framed")
def canonical_order(spark, sf_dir):
    return frames.canonical_order(framed(spark, sf_dir), "page_id").select("page_id", "element_id", F.col("canonical").cast("long").alias("canonical"))


@query(f"""WITH {OBS_SQL}, p AS (SELECT page_id, greatest(64, 4 * count(*)) AS cells, greatest(0.0001, least(10000.0, max(x1) / max(y1))) AS shape FROM obs GROUP BY 1)
SELECT page_id, greatest(4, least(4096, ceil(sqrt(cells * shape))))::BIGINT AS across, greatest(4, least(4096, ceil(sqrt(cells / shape))))::BIGINT AS down FROM p""")
def grid_resolutions(spark, sf_dir):
    pages = observations(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("x1").alias("w"), F.max("y1").alias("h"))
    across, down = frames.grid_resolution(F.col("n"), F.col("w"), F.col("h"))
    return pages.select("page_id", across.alias("across"), down.alias("down"))


RANKED = f"""{FRAMED}, shaped AS (SELECT *, CASE WHEN element_id % 2 = 0 THEN 'poly' || element_id END AS polygon, CASE WHEN element_id % 3 = 0 THEN 'crop' || element_id END AS source_crop, CASE WHEN element_id % 3 = 0 THEN y0 / 1200 END AS layout FROM framed)"""


@query(f"""WITH {RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY -coalesce(layout, confidence, 0.5), {KEY}) AS n FROM shaped)
SELECT page_id, arg_min(polygon, n) FILTER (polygon IS NOT NULL) AS polygon, arg_min(source_crop, n) FILTER (source_crop IS NOT NULL) AS source_crop FROM r GROUP BY 1""")
def geometry_choice(spark, sf_dir):
    rows = framed(spark, sf_dir).withColumns({"polygon": F.when(F.col("element_id") % 2 == 0, F.concat(F.lit("poly"), "element_id")), "source_crop": F.when(F.col("element_id") % 3 == 0, F.concat(F.lit("crop"), "element_id")), "layout": F.when(F.col("element_id") % 3 == 0, F.col("y0") / 1200)})
    return frames.first_by_preference(frames.preferred(rows, ["page_id"], F.col("layout")), ["page_id"], ["polygon", "source_crop"])


@query(f"""WITH {FRAMED}, v AS (SELECT page_id, element_id % 3 AS z, round(sum(coalesce(confidence, 0.5)), 9) AS w FROM framed GROUP BY 1, 2)
SELECT page_id, z::INTEGER AS z_index FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY -w, z) AS n FROM v) WHERE n = 1""")
def fused_z_index(spark, sf_dir):
    return frames.choose_z(framed(spark, sf_dir).withColumn("z_index", (F.col("element_id") % 3).cast("int")), ["page_id"])


@query(f"""WITH {FRAMED}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY -coalesce(confidence, 0.5), {KEY}) AS n FROM framed),
c AS (SELECT page_id, n, unnest([element_id + 1, element_id % 2]) AS v, unnest([1, 2]) AS k FROM r WHERE element_id % 5 <> 0), f AS (SELECT page_id, v, min(n * 10 + k) AS p FROM c GROUP BY 1, 2), j AS (SELECT page_id, string_agg(v::VARCHAR, ',' ORDER BY p) AS children FROM f GROUP BY 1),
s AS (SELECT page_id, arg_min('p' || element_id, n) FILTER (element_id % 2 = 0) AS parent FROM r GROUP BY 1) SELECT page_id, parent, coalesce(children, '') AS children FROM s LEFT JOIN j USING (page_id)""")
def fused_relationships(spark, sf_dir):
    e = F.col("element_id")
    rows = framed(spark, sf_dir).withColumns({"parent": F.when(e % 2 == 0, F.concat(F.lit("p"), e)), "children": F.when(e % 5 != 0, F.array(e + 1, e % 2))})
    ranked = frames.preferred(rows, ["page_id"])
    plural = frames.merged_lists(ranked, ["page_id"], ["children"]).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))
    return frames.first_by_preference(ranked, ["page_id"], ["parent"]).join(plural, "page_id")


RECORD = "lower(engine) || '|' || source || '|' || round(coalesce(confidence, 0) * 100)::INTEGER"


@query(f"WITH {FRAMED} SELECT page_id, string_agg(DISTINCT {RECORD}, ';' ORDER BY {RECORD}) AS contributors FROM framed GROUP BY 1")
def provenance_contributors(spark, sf_dir):
    record = F.concat_ws("|", F.lower("engine"), "source", F.round(F.coalesce("confidence", F.lit(0.0)) * 100).cast("int").cast("string"))
    return frames.contributors(framed(spark, sf_dir), ["page_id"], record).withColumn("contributors", F.array_join("contributors", ";"))


@query(f"WITH {FRAMED} SELECT page_id, 'page-source:' || sha256(string_agg(kind || '|' || text || '|' || x0::INTEGER, ',' ORDER BY kind || '|' || text || '|' || x0::INTEGER)) AS identity FROM framed GROUP BY 1")
def page_identities(spark, sf_dir):
    return frames.identities(framed(spark, sf_dir), ["page_id"], F.concat_ws("|", "kind", "text", F.col("x0").cast("int").cast("string")))


@query(f"""WITH RECURSIVE {OBS_SQL}, p AS (SELECT a.page_id, a.element_id AS a, b.element_id AS b FROM (SELECT *, kind IN ('title', 'text') AS worded FROM obs) a JOIN (SELECT *, kind IN ('title', 'text') AS worded FROM obs) b ON a.page_id = b.page_id AND a.source < b.source AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
  WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) >= 0.1),
e AS (SELECT page_id, a, b FROM p UNION SELECT page_id, b, a FROM p), r AS (SELECT DISTINCT page_id, a AS node, a AS other FROM e UNION SELECT r.page_id, r.node, e.b FROM r JOIN e ON e.page_id = r.page_id AND e.a = r.other)
SELECT page_id, node, min(other) AS component FROM r GROUP BY 1, 2""")
def bipartite_components(spark, sf_dir):
    pairs = matching.correlated_pairs(observations(spark, sf_dir), least=0.1).select("page_id", F.col("element_id").alias("a"), F.col("element_id2").alias("b"))
    return frames.page_components(pairs, "page_id")
