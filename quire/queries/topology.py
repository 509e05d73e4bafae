"""Regions and edges of reading-order graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import OBS_SQL, observations
from ..operators import topology
from ..registry import query

KINDS = ["header", "paragraph", "table", "figure", "caption", "footnote", "page_number"]


def laid_out(spark, sf_dir):
    """Elements of all region kinds; one in five pages has a floating box, and elements stand in two columns."""
    e = F.col("element_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (e % 7 + 1).cast("int"))
    return observations(spark, sf_dir).withColumns({"kind": kind, "role": F.when((F.col("page_id") % 5 == 0) & (e % 7 == 1), "Text-Box"), "column": ((e - 1) % 2).cast("int"), "reading_order": F.when(e % 3 != 0, (7 - e).cast("int"))})


LAID = f"""{OBS_SQL}, laid AS (SELECT page_id, element_id, x0, y0, x1, y1, {KINDS}[element_id % 7 + 1] AS kind, page_id % 5 = 0 AND element_id % 7 = 1 AS floats, (element_id - 1) % 2 AS col, CASE WHEN element_id % 3 <> 0 THEN 7 - element_id END AS reading_order FROM obs),
typed AS (SELECT *, CASE WHEN floats THEN 'floating' WHEN kind = 'page_number' THEN 'footer' WHEN kind <> 'paragraph' THEN kind END AS rk FROM laid)"""
SHARE = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0)"
SEGMENTS = f"""{LAID}, flow AS (SELECT a.*, (SELECT count(*) FROM typed b WHERE b.page_id = a.page_id AND b.rk IN ('table', 'formula', 'figure', 'caption') AND b.y0 + b.y1 < a.y0 + a.y1 AND {SHARE} >= 0.20) AS segment FROM typed a WHERE rk IS NULL)"""
REGIONS = f"""{SEGMENTS}, named AS (SELECT page_id, element_id, x0, y0, x1, y1, rk AS region_kind, CASE WHEN rk IN ('header', 'footer', 'footnote') THEN rk ELSE rk || ':' || element_id END AS region_id FROM typed WHERE rk IS NOT NULL
  UNION ALL SELECT page_id, element_id, x0, y0, x1, y1, 'column', 'column:' || col || ':' || segment FROM flow),
regions AS (SELECT page_id, region_id, region_kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(element_id::VARCHAR, ',' ORDER BY element_id) AS members FROM named GROUP BY 1, 2, 3)"""
SEMANTIC = f"""{REGIONS}, pairs AS (SELECT a.page_id, a.region_id AS src, b.region_id AS dst, a.region_kind AS k, b.region_kind AS k2 FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.region_id <> b.region_id),
semantic AS (SELECT page_id, src, dst, CASE WHEN k2 = 'footnote' AND k <> 'header' THEN 'footnote' ELSE 'page_boundary' END AS relation, CASE WHEN k2 = 'footnote' AND k <> 'header' THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence,
  CASE WHEN k = 'header' THEN 'semantic.page_header' WHEN k2 = 'footer' THEN 'semantic.page_footer' ELSE 'semantic.page_footnote' END AS reason
  FROM pairs WHERE (k = 'header' AND k2 <> 'header') OR (k <> 'footer' AND k2 = 'footer') OR (k NOT IN ('header', 'footer', 'footnote') AND k2 = 'footnote'))"""
PRECEDENCE = f"""{SEMANTIC}, body AS (SELECT * FROM regions WHERE region_kind NOT IN ('header', 'footer', 'footnote', 'floating')),
precedence AS (SELECT a.page_id, a.region_id AS src, b.region_id AS dst, 'flow' AS relation, greatest(0.60, least(0.95, 0.80 + 0.15 * least(1.0, greatest(0, b.y0 - a.y1) / greatest(a.y1 - a.y0, b.y1 - b.y0, 1.0)))) AS confidence, 'geometry.vertical_precedence' AS reason
  FROM body a JOIN body b ON a.page_id = b.page_id AND a.region_id <> b.region_id AND (a.y0 + a.y1 < b.y0 + b.y1 OR (a.y0 + a.y1 = b.y0 + b.y1 AND a.region_id < b.region_id))
  WHERE {SHARE} >= 0.20 AND NOT (a.y1 > b.y0 AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) >= 0.20))"""
EDGE = "page_id, src, dst, relation, round(confidence, 9) AS confidence, reason"


def regions_of(spark, sf_dir):
    return topology.page_regions(laid_out(spark, sf_dir), "page_id")


@query(f"WITH {SEGMENTS} SELECT page_id, element_id, segment FROM flow")
def column_segments(spark, sf_dir):
    rows = laid_out(spark, sf_dir)
    typed = rows.withColumn("rk", topology.region_kind(F.col("kind"), F.col("role")))
    return topology.column_segments(typed, F.col("rk").isin(*topology.BLOCKING), "page_id").where("rk is null").select("page_id", "element_id", "segment")


@query(f"WITH {REGIONS} SELECT * FROM regions")
def page_regions(spark, sf_dir):
    return regions_of(spark, sf_dir).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(f"WITH {SEMANTIC} SELECT {EDGE} FROM semantic")
def semantic_edges(spark, sf_dir):
    return topology.semantic_edges(regions_of(spark, sf_dir), "page_id").withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {PRECEDENCE} SELECT {EDGE} FROM precedence")
def precedence_edges(spark, sf_dir):
    return topology.precedence_edges(regions_of(spark, sf_dir), "page_id").withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {PRECEDENCE} SELECT {EDGE} FROM semantic UNION ALL SELECT {EDGE} FROM precedence")
def reading_graph(spark, sf_dir):
    """Both kinds of edges; none closes a cycle (page_edges() says why), so graphs.acyclic() has nothing to leave out."""
    return topology.page_edges(regions_of(spark, sf_dir), "page_id").withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {LAID} SELECT page_id, element_id, row_number() OVER (PARTITION BY page_id ORDER BY reading_order NULLS LAST, y0, x0, element_id) - 1 AS place FROM laid")
def hinted_order(spark, sf_dir):
    return topology.hinted_order(laid_out(spark, sf_dir), "page_id").select("page_id", "element_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT *, CASE WHEN element_id % 2 = 0 THEN element_id + 1 END AS caption_of FROM obs WHERE element_id % 3 = 0), f AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN [element_id + 2, element_id - 1] ELSE [] END AS kids FROM obs WHERE element_id % 3 <> 0),
n AS (SELECT c.page_id, c.element_id AS item_id, f.element_id AS named FROM c JOIN f ON c.page_id = f.page_id AND c.caption_of = f.element_id), k AS (SELECT f.page_id, c.element_id AS item_id, min(f.element_id) AS parent FROM f JOIN c ON c.page_id = f.page_id AND list_contains(f.kids, c.element_id) GROUP BY 1, 2),
g AS (SELECT page_id, item_id, near FROM (SELECT a.page_id, a.element_id AS item_id, b.element_id AS near, row_number() OVER (PARTITION BY a.page_id, a.element_id ORDER BY abs(a.y0 + a.y1 - b.y0 - b.y1), abs(a.x0 + a.x1 - b.x0 - b.x1), b.element_id) AS n FROM c a JOIN f b ON a.page_id = b.page_id WHERE {SHARE} >= 0.25) WHERE n = 1)
SELECT c.page_id, c.element_id AS item_id, coalesce(named, parent, near) AS target_id, CASE WHEN named IS NOT NULL OR parent IS NOT NULL THEN 1.0 WHEN near IS NOT NULL THEN 0.75 END::DOUBLE AS confidence,
  CASE WHEN named IS NOT NULL THEN 'canonical.relationship.caption_of' WHEN parent IS NOT NULL THEN 'canonical.relationship.children' WHEN near IS NOT NULL THEN 'geometry.nearest_figure_caption' END AS reason
FROM c LEFT JOIN n ON n.page_id = c.page_id AND n.item_id = c.element_id LEFT JOIN k ON k.page_id = c.page_id AND k.item_id = c.element_id LEFT JOIN g ON g.page_id = c.page_id AND g.item_id = c.element_id""")
def caption_links(spark, sf_dir):
    rows, e = observations(spark, sf_dir), F.col("element_id")
    captions = rows.where(e % 3 == 0).select("page_id", e.alias("item_id"), F.when(e % 2 == 0, e + 1).alias("caption_of"), "x0", "y0", "x1", "y1")
    figures = rows.where(e % 3 != 0).select("page_id", e.alias("target_id"), F.when(F.col("page_id") % 2 == 0, F.array(e + 2, e - 1)).otherwise(F.array().cast("array<int>")).alias("children"), "x0", "y0", "x1", "y1")
    return topology.caption_links(captions, figures, "page_id")
