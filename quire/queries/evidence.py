"""Units of sources on scans, and what they meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import OBS_SQL, lines, observations
from ..operators import evidence
from ..registry import query

BLOCKS = ["QUERY", "LINE", "WORD", "CELL", "MERGED_CELL", "TABLE"]


@query(f"""WITH {OBS_SQL}, e AS (SELECT page_id, element_id, {BLOCKS}[element_id % 6 + 1] AS block_type, element_id + CASE WHEN page_id % 2 = 0 THEN -1 ELSE 1 END AS parent, CASE WHEN element_id % 6 = 5 OR page_id % 7 = 0 THEN 'table' ELSE 'text' END AS kind, CASE WHEN x0::INT % 3 <> 0 THEN text END AS text FROM obs)
SELECT e.page_id, e.element_id FROM e LEFT JOIN e p ON p.page_id = e.page_id AND p.element_id = e.parent WHERE NOT coalesce(e.block_type = 'QUERY' OR (e.block_type IN ('CELL', 'MERGED_CELL') AND p.kind = 'table') OR (e.block_type = 'WORD' AND coalesce(p.text, '') <> '' AND p.element_id IS NOT NULL), false)""")
def kept_children(spark, sf_dir):
    e = F.col("element_id")
    rows = observations(spark, sf_dir).select("page_id", e, F.element_at(F.array(*map(F.lit, BLOCKS)), (e % 6 + 1).cast("int")).alias("block_type"), (e + F.when(F.col("page_id") % 2 == 0, -1).otherwise(1)).alias("parent"), F.when((e % 6 == 5) | (F.col("page_id") % 7 == 0), "table").otherwise("text").alias("kind"), F.when(F.col("x0").cast("int") % 3 != 0, F.col("text")).alias("text"))
    return evidence.drop_redundant(rows, "page_id").select("page_id", "element_id")


def scanned(spark, sf_dir):
    p = F.col("page_id") % 3
    return observations(spark, sf_dir).withColumns({
        "width": F.lit(160.0), "height": F.lit(200.0), "scan_width": F.when(p == 0, 1600.0).when(p == 1, 830.0).otherwise(1000.0), "scan_height": F.when(p == 0, 2000.0).otherwise(1000.0),
        "reading_order": F.when(F.col("element_id") % 2 == 0, F.col("element_id")), "system": F.when(F.col("element_id") % 5 == 0, "synthetic"), "text": F.when(F.col("x0").cast("int") % 4 != 0, F.col("text")),
        "kind": F.when(F.col("kind") == "unknown", "figure").otherwise(F.col("kind")), "doc": F.floor(F.col("page_id") / 3),
    })


SCANNED = f"""{OBS_SQL}, held AS (SELECT *, least(160.0, greatest(0.0, x0)) AS hx0, least(200.0, greatest(0.0, y0)) AS hy0, least(160.0, greatest(0.0, x1)) AS hx1, least(200.0, greatest(0.0, y1)) AS hy1,
  CASE page_id % 3 WHEN 0 THEN 1600.0 WHEN 1 THEN 830.0 ELSE 1000.0 END::DOUBLE AS sw, CASE page_id % 3 WHEN 0 THEN 2000.0 ELSE 1000.0 END::DOUBLE AS sh FROM obs),
lefts AS (SELECT *, least(sw - 1, floor(hx0 / 160 * sw))::BIGINT AS l, least(sh - 1, floor(hy0 / 200 * sh))::BIGINT AS t, page_id % 3 <> 2 AND hx1 > hx0 AND hy1 > hy0 AS ok FROM held),
scanned AS (SELECT *, CASE WHEN ok THEN l END AS px0, CASE WHEN ok THEN t END AS py0, CASE WHEN ok THEN greatest(l + 1, least(sw, ceil(hx1 / 160 * sw)))::BIGINT END AS px1, CASE WHEN ok THEN greatest(t + 1, least(sh, ceil(hy1 / 200 * sh)))::BIGINT END AS py1 FROM lefts)"""


@query(f"WITH {SCANNED} SELECT page_id, element_id, px0, py0, px1, py1 FROM scanned")
def projected_boxes(spark, sf_dir):
    from ..functions import geometry as g

    px = evidence.projected_box(g.box(), F.col("width"), F.col("height"), F.col("scan_width"), F.col("scan_height"))
    return scanned(spark, sf_dir).select("page_id", "element_id", *[c.alias(n) for c, n in zip(px, ("px0", "py0", "px1", "py1"), strict=True)])


@query(f"""WITH {SCANNED}, u AS (SELECT *, page_id // 3 AS doc, CASE WHEN element_id % 2 = 0 THEN element_id END AS ro FROM scanned WHERE px0 IS NOT NULL AND element_id % 5 <> 0 AND (x0::INT % 4 <> 0 OR kind = 'unknown'))
SELECT doc, page_id, element_id, x0 < 0 OR y0 < 0 OR x1 > 160 OR y1 > 200 AS clipped, row_number() OVER (PARTITION BY doc ORDER BY page_id, ro IS NULL, coalesce(ro, element_id), element_id) - 1 AS position FROM u""")
def evidence_units(spark, sf_dir):
    return evidence.evidence_units(scanned(spark, sf_dir), "page_id", "doc").select("doc", "page_id", "element_id", "clipped", F.col("position").cast("long").alias("position"))


@query(f"""WITH {OBS_SQL}, r AS (SELECT o.page_id, o.element_id AS region_id, o.x0, o.y0, o.x1, o.y1, l_partkey % 4 AS h, l_suppkey % 5 AS v FROM obs o JOIN lines ON l_orderkey = page_id AND l_linenumber = element_id), i AS (SELECT * FROM obs WHERE kind = 'title'),
ruled AS (SELECT * FROM r WHERE v > 0 AND (h >= 2 OR v >= 3))
SELECT page_id, region_id FROM ruled a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.page_id = a.page_id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
  AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1.0, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))) >= 0.55)""")
def table_regions(spark, sf_dir):
    rules = lines(spark, sf_dir).select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("element_id"), (F.col("l_partkey") % 4).alias("horizontal_rules"), (F.col("l_suppkey") % 5).alias("vertical_rules"))
    rows = observations(spark, sf_dir)
    return evidence.table_regions(rows.join(rules, ["page_id", "element_id"]).withColumnRenamed("element_id", "region_id"), rows.where("kind = 'title'"), "page_id").select("page_id", "region_id")


@query()
def matched_tables(spark, sf_dir):
    """Tables of a page's text against its ruled regions; the greedy merge has no SQL form and is held against brute force."""
    rows = lines(spark, sf_dir)
    tables = rows.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_linenumber").alias("block_index"), (F.col("l_partkey") % 4).alias("rows"), (1 + F.col("l_suppkey") % 4).alias("columns"), F.when(F.col("l_orderkey") % 2 == 0, "g").alias("group_id"))
    ruled = rows.where("l_linenumber % 2 = 0 or l_tax > 0.05").select("l_orderkey", F.col("l_linenumber").alias("place"), (F.col("l_partkey") % 6).alias("horizontal_rules"), (F.col("l_suppkey") % 7).alias("vertical_rules"), (F.col("l_quantity") / 8).alias("aspect"))
    return evidence.match_tables(tables, ruled, "l_orderkey").withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH {OBS_SQL}, p AS (SELECT page_id, kind, element_id AS block_id, confidence, x0, y0, x1, y1 FROM obs), d AS (SELECT page_id, kind, element_id + 100 AS detection_id, element_id / 10 AS score, x0, y0, x1 + CASE WHEN element_id % 3 = 2 THEN 9 ELSE 0.2 END AS x1, y1 FROM obs),
m AS (SELECT p.page_id, d.detection_id, min(p.block_id) AS block_id, min(d.score) AS score FROM p JOIN d ON p.page_id = d.page_id AND p.kind = d.kind AND least(p.x1, d.x1) > greatest(p.x0, d.x0) AND least(p.y1, d.y1) > greatest(p.y0, d.y0)
  WHERE (least(p.x1, d.x1) - greatest(p.x0, d.x0)) * (least(p.y1, d.y1) - greatest(p.y0, d.y0)) / ((p.x1 - p.x0) * (p.y1 - p.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) - (least(p.x1, d.x1) - greatest(p.x0, d.x0)) * (least(p.y1, d.y1) - greatest(p.y0, d.y0))) >= 0.98 GROUP BY 1, 2),
o AS (SELECT page_id, block_id, arg_max(score, detection_id) AS layout, arg_min(score, detection_id) AS own FROM m GROUP BY 1, 2)
SELECT p.page_id, p.block_id AS id, coalesce(confidence, own) AS confidence, layout AS layout_confidence FROM p LEFT JOIN o USING (page_id, block_id) UNION ALL SELECT page_id, detection_id, score, NULL FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = d.page_id AND m.detection_id = d.detection_id)""")
def merged_detections(spark, sf_dir):
    rows, e = observations(spark, sf_dir), F.col("element_id")
    parsed = rows.withColumnRenamed("element_id", "block_id")
    found = rows.withColumns({"detection_id": e + 100, "confidence": e / 10, "x1": F.col("x1") + F.when(e % 3 == 2, 9.0).otherwise(0.2)})
    blocks, rest = evidence.merge_detections(parsed, found, "page_id")
    return blocks.select("page_id", F.col("block_id").alias("id"), "confidence", "layout_confidence").unionByName(rest.select("page_id", F.col("detection_id").alias("id"), "confidence", F.lit(None).cast("double").alias("layout_confidence")))


def _folded(joins: str) -> str:
    return f"""WITH RECURSIVE {OBS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, y1, x1) AS k FROM obs),
f AS (SELECT page_id, k, 0 AS r, x0, y0, x1, y1, 1 AS n FROM b WHERE k = 1 UNION ALL SELECT page_id, k, CASE WHEN j THEN r ELSE r + 1 END, CASE WHEN j THEN least(px0, x0) ELSE x0 END, CASE WHEN j THEN least(py0, y0) ELSE y0 END, CASE WHEN j THEN greatest(px1, x1) ELSE x1 END, CASE WHEN j THEN greatest(py1, y1) ELSE y1 END, CASE WHEN j THEN n + 1 ELSE 1 END
  FROM (SELECT b.page_id, b.k, f.r, f.n, f.x0 AS px0, f.y0 AS py0, f.x1 AS px1, f.y1 AS py1, b.x0, b.y0, b.x1, b.y1, {joins} AS j FROM f JOIN b ON b.page_id = f.page_id AND b.k = f.k + 1))
SELECT page_id, r::BIGINT AS "row", arg_max(x0, k) AS x0, arg_max(y0, k) AS y0, arg_max(x1, k) AS x1, arg_max(y1, k) AS y1, max(n)::BIGINT AS n FROM f GROUP BY 1, 2"""


@query(_folded("greatest(0.0, least(b.y1, f.y1) - greatest(b.y0, f.y0)) / greatest(1.0, least(b.y1 - b.y0, f.y1 - f.y0)) >= 0.55"))
def merged_rows(spark, sf_dir):
    return evidence.merged_rows(observations(spark, sf_dir), "page_id")


@query(_folded("abs((b.y0 + b.y1) - (f.y0 + f.y1)) / 2 <= 5.0"))
def visual_rows(spark, sf_dir):
    return evidence.merged_rows(observations(spark, sf_dir), "page_id", F.lit(5.0))


BANDS = [(0.0, 80.0, 0.0, 5.0, 160.0, 150.0, 0.0, 100.0), (80.0, 160.0, 5.0, 10.0, 150.0, 155.0, 100.0, 190.0), (170.0, 400.0, 10.0, 0.0, 155.0, 160.0, 190.0, 420.0)]


@query(f"""WITH {OBS_SQL}, bands(sy0, sy1, left0, left1, right0, right1, ty0, ty1) AS (VALUES {", ".join(map(str, BANDS))}),
m AS (SELECT page_id, element_id, x0, x1, greatest(y0, 0.0) AS c0, least(y1, 400.0) AS c1, bands.* FROM obs, bands), o AS (SELECT *, greatest(c0, sy0) AS a, least(c1, sy1) AS b FROM m WHERE c1 > c0), p AS (SELECT *, unnest([a, b]) AS sy FROM o WHERE b > a),
q AS (SELECT *, (sy - sy0) / (sy1 - sy0) AS s FROM p), e AS (SELECT *, left0 + (left1 - left0) * s AS l, right0 + (right1 - right0) * s AS r, ty0 + (ty1 - ty0) * s AS ty FROM q), z AS (SELECT *, greatest(x0, l) AS p0, least(x1, r) AS p1 FROM e)
SELECT page_id, element_id, round(min((p0 - l) / (r - l) * 160.0) FILTER (p1 > p0), 6) AS px0, round(min(ty) FILTER (p1 > p0), 6) AS py0, round(max((p1 - l) / (r - l) * 160.0) FILTER (p1 > p0), 6) AS px1, round(max(ty) FILTER (p1 > p0), 6) AS py1
FROM z GROUP BY 1, 2 HAVING sum(b - a) / 2 >= 0.98 * (max(c1) - min(c0)) AND count(*) FILTER (p1 > p0) > 0""")
def mesh_boxes(spark, sf_dir):
    rows = observations(spark, sf_dir).select("page_id", "element_id", "x0", "y0", "x1", "y1")
    bands = spark.createDataFrame(BANDS, "sy0 double, sy1 double, left0 double, left1 double, right0 double, right1 double, ty0 double, ty1 double").withColumn("target_width", F.lit(160.0))
    meshes = rows.select("page_id").distinct().join(F.broadcast(bands), how="cross")
    return evidence.mesh_boxes(rows, meshes, ["page_id", "element_id"]).select("page_id", "element_id", *[F.round(c, 6).alias(c) for c in ("px0", "py0", "px1", "py1")])
