"""Rendered documents, alignment, small helpers of boxes and order, and totals of routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import LINES_SQL, OBS_SQL, document_lines, lines, observations, table
from ..functions import geometry as g
from ..functions import text as t
from ..operators import alignment, metrics, routing, sequences
from ..registry import query
from ..sources import sinks


@query(f"""WITH {OBS_SQL}, e AS (SELECT page_id // 10 AS doc, page_id, element_id, '{{"reading_order":' || element_id || ',"kind":"' || kind || '","text":"' || text || '"}}' AS j FROM obs), p AS (SELECT doc, page_id, string_agg(j, ',' ORDER BY element_id) AS j FROM e GROUP BY 1, 2)
SELECT doc, '{{"pages":[' || string_agg('{{"page_id":' || page_id || ',"elements":[' || j || ']}}', ',' ORDER BY page_id) || ']}}' AS json FROM p GROUP BY 1""")
def rendered_json(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.floor(F.col("page_id") / 10).alias("doc"), "page_id", F.col("element_id").alias("reading_order"), "kind", "text")
    return sinks.documents_json(rows, "doc", "page_id")


@query(f"""WITH {OBS_SQL}, d AS (SELECT page_id // 10 AS doc, page_id, y0, x0, '<div class="' || kind || '" style="left:' || printf('%.2f', x0) || 'px;top:' || printf('%.2f', y0) || 'px;width:' || printf('%.2f', x1 - x0) || 'px;height:' || printf('%.2f', y1 - y0) || 'px">' || text || ' &lt;b&gt; &amp; &quot;q&quot;</div>' AS d FROM obs)
SELECT doc, page_id, string_agg(d, chr(10) ORDER BY y0, x0, d) AS html FROM d GROUP BY 1, 2""")
def rendered_html(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumns({"doc": F.floor(F.col("page_id") / 10), "text": F.concat("text", F.lit(' <b> & "q"'))})
    return sinks.absolute_html(rows, "doc", "page_id")


@query(f"""WITH {OBS_SQL}, e AS (SELECT *, CASE WHEN element_id % 3 <> 0 THEN 10 - element_id END AS ro FROM obs) SELECT page_id, element_id, row_number() OVER (PARTITION BY page_id ORDER BY ro NULLS LAST, element_id) - 1 AS place, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id, element_id) - 1 AS ordinal FROM e""")
def ordered_elements(spark, sf_dir):
    """Elements in reading order with unknown hints last, and their numbers in the document."""
    rows = observations(spark, sf_dir).withColumns({"doc": F.floor(F.col("page_id") / 10), "reading_order": F.when(F.col("element_id") % 3 != 0, 10 - F.col("element_id"))})
    return sequences.numbered(rows, "doc", "page_id").select("page_id", "element_id", "place", "ordinal")


@query(f"""WITH {OBS_SQL}, p AS (SELECT a.page_id, a.element_id, b.element_id AS element_id2, a.x0, a.y0, a.x1, a.y1, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS o, (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS s2, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1
  FROM obs a JOIN obs b ON a.page_id = b.page_id AND b.element_id = a.element_id + 1)
SELECT page_id, element_id, round(CASE WHEN s + s2 - o = 0 THEN 1 ELSE o / (s + s2 - o) END, 9) AS iou, round(o / s, 9) AS share, round(greatest(0, least(1, x0 / 90)), 8) AS n0, round(greatest(0, least(1, y1 / 90)), 8) AS n1, least(x0, bx0) AS u0, greatest(y1, by1) AS u1,
  CASE WHEN least(90, x0) < least(90, x1) AND least(90, y0) < least(90, y1) THEN least(90, x1) END AS clipped, round(x0 * 3 / 2) AS scaled FROM p""")
def pixel_boxes(spark, sf_dir):
    """Helpers of pixel boxes: overlap, shares, unions, clipping and scaling."""
    rows = observations(spark, sf_dir)
    other = rows.select("page_id", (F.col("element_id") - 1).alias("element_id"), *[F.col(c).alias(f"{c}2") for c in ("x0", "y0", "x1", "y1")])
    a, b = g.box(), g.box(suffix="2")
    shares, union, clipped, scaled = g.normalized_box(a, F.lit(90.0), F.lit(90.0)), g.union(a, b), g.clipped(a, F.lit(90.0), F.lit(90.0)), g.scaled(a, (2, 2), (3, 3))
    return rows.join(other, ["page_id", "element_id"]).select("page_id", "element_id", F.round(g.pixel_iou(a, b), 9).alias("iou"), F.round(g.overlap(a, b) / g.area(a), 9).alias("share"), shares[0].alias("n0"), shares[3].alias("n1"), union[0].alias("u0"), union[3].alias("u1"), clipped[2].alias("clipped"), scaled[0].alias("scaled"))


@query(f"""WITH {OBS_SQL} SELECT page_id, element_id, round(avg(x1) OVER (PARTITION BY page_id ORDER BY element_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth, round(avg((x1 > 80)::INT) OVER (PARTITION BY page_id ORDER BY element_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS fraction FROM obs""")
def smoothed_profiles(spark, sf_dir):
    rows = sequences.smoothed(observations(spark, sf_dir), ["page_id"], "element_id", "x1", 2, "smooth")
    rows = sequences.smoothed(rows.withColumn("on", (F.col("x1") > 80).cast("int")), ["page_id"], "element_id", "on", 1, "fraction")
    return rows.select("page_id", "element_id", F.round("smooth", 6).alias("smooth"), F.round("fraction", 6).alias("fraction"))


ROUTED = f"""{OBS_SQL}, e AS (SELECT page_id, element_id, CASE WHEN element_id % 4 = 0 THEN 'table' WHEN kind = 'title' THEN 'image' ELSE 'text' END AS kind, coalesce(confidence < 0.95, false) AS low, source = 'src0' AS same, x0::INT % 3 = 0 AS split FROM obs),
r AS (SELECT *, same AND (low OR split) AS turn FROM e WHERE kind <> 'image' AND (low OR split OR kind = 'table')), k AS (SELECT page_id, CASE WHEN low OR split THEN 6.0 ELSE 1.0 END AS cost, CASE WHEN NOT turn THEN 'paddleocr' WHEN kind = 'table' THEN 'mineru' ELSE 'olmocr' END AS p FROM r)"""


@query(f"WITH {ROUTED} SELECT page_id, count(*) AS tasks, round(sum(cost), 6)::DOUBLE AS cost, coalesce(string_agg(DISTINCT p, ',' ORDER BY p) FILTER (p <> 'paddleocr'), '') AS unavailable FROM k GROUP BY 1")
def routing_totals(spark, sf_dir):
    """What a page's tasks cost together, and which of their providers are not there."""
    rows = observations(spark, sf_dir).select(
        "page_id", "element_id", F.when(F.col("element_id") % 4 == 0, "table").when(F.col("kind") == "title", "image").otherwise("text").alias("kind"), "confidence", F.when(F.col("source") == "src0", "paddleocr").otherwise("mineru").alias("existing"),
        F.when(F.col("x0").cast("int") % 3 == 0, F.array(F.lit("A  b"), F.lit("c"))).otherwise(F.array(F.lit("A  b"), F.lit("a b "))).alias("readings"), F.lit(False).alias("handwritten"), F.lit(False).alias("complex_layout"),
    )
    totals = routing.plan_totals(routing.route(rows, 0.95), ["page_id"], ["paddleocr", "native_pdf"])
    return totals.select("page_id", "tasks", F.round("cost", 6).alias("cost"), F.array_join("unavailable", ",").alias("unavailable"))


@query(f"""WITH {OBS_SQL}, m AS (SELECT page_id, element_id % 2 AS k, 'k' || (element_id % 3) AS key, 'v' || (element_id % 2 + page_id % 2 * (element_id % 3)) AS v FROM obs), a AS (SELECT page_id, key, min(v) FILTER (k = 0) AS x, min(v) FILTER (k = 1) AS y FROM m GROUP BY 1, 2)
SELECT page_id, round(avg((x IS NOT DISTINCT FROM y)::INT), 9) AS relationship_accuracy FROM a GROUP BY 1""")
def relationship_scores(spark, sf_dir):
    e = F.col("element_id")
    rows = observations(spark, sf_dir).select("page_id", (e % 2).alias("k"), F.concat(F.lit("k"), e % 3).alias("key"), F.concat(F.lit("v"), e % 2 + F.col("page_id") % 2 * (e % 3)).alias("v"))
    one = rows.groupBy("page_id", "key", "k").agg(F.min("v").alias("v"))
    pick = lambda k: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("k") == k, F.struct("key", "v"))), lambda x: x.isNotNull()))
    pairs = one.groupBy("page_id").agg(pick(0).alias("a"), pick(1).alias("b"))
    return metrics.relationship_accuracy(pairs, ["page_id"], "a", "b").withColumn("relationship_accuracy", F.round("relationship_accuracy", 9))


UNITS = f"""{LINES_SQL}, u AS (SELECT l_orderkey // 4 AS doc_id, 'src' || (l_orderkey % 2) AS source, l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey // 4, l_orderkey % 2 ORDER BY l_orderkey, l_linenumber) - 1 AS position, 'unit ' || (l_partkey % 6) AS text, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 70)::DOUBLE AS y0, (l_partkey % 50 + 20)::DOUBLE AS x1, (l_suppkey % 70 + 9)::DOUBLE AS y1 FROM lines)"""


def units(spark, sf_dir):
    rows = document_lines(spark, sf_dir, 4, F.col("l_orderkey") % 2 == 1).withColumnRenamed("doc", "doc_id")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return rows.select("doc_id", F.concat(F.lit("src"), (F.col("l_orderkey") % 2).cast("string")).alias("source"), F.col("l_orderkey").alias("page"), F.col("position").cast("long").alias("position"), F.lit("text").alias("kind"), F.concat(F.lit("unit "), p % 6).alias("text"), F.lit(0.9).alias("confidence"), (p % 50).cast("double").alias("x0"), (s % 70).cast("double").alias("y0"), (p % 50 + 20).cast("double").alias("x1"), (s % 70 + 9).cast("double").alias("y1"))


@query(f"""WITH {UNITS}, r AS (SELECT a.doc_id, a.source, a.position AS first, a.text || ' ' || b.text AS key FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.source = b.source AND a.page = b.page AND b.position = a.position + 1 UNION ALL SELECT doc_id, source, position, text FROM u),
o AS (SELECT doc_id, source, key, min(first) AS first FROM r GROUP BY 1, 2, 3 HAVING count(*) = 1), b AS (SELECT doc_id, i AS block_index, 'unit ' || ((doc_id + i) % 6) || CASE WHEN i % 2 = 0 THEN ' unit ' || ((doc_id + 2 * i) % 6) ELSE '' END AS key FROM (SELECT DISTINCT doc_id FROM u), (SELECT unnest(range(0, 8)) AS i)),
n AS (SELECT doc_id, key, min(block_index) AS block_index FROM b GROUP BY 1, 2 HAVING count(*) = 1) SELECT n.doc_id, source, block_index, first FROM n JOIN o USING (doc_id, key)""")
def exact_anchors(spark, sf_dir):
    rows = units(spark, sf_dir)
    i, d = F.col("block_index"), F.col("doc_id")
    text = F.concat(F.lit("Unit "), (d + i) % 6, F.when(i % 2 == 0, F.concat(F.lit("  unit "), (d + 2 * i) % 6)).otherwise(""))
    blocks = rows.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block_index")).withColumn("text", text)
    return alignment.exact_anchors(blocks, rows, 2).select("doc_id", "source", "block_index", "first")


@query(f"""WITH {UNITS}, m AS (SELECT doc_id, source, block_index, block_index * 2 AS first, block_index * 2 + 2 AS end_, 0.75 + (block_index % 2) / 8 AS score FROM (SELECT DISTINCT doc_id, source FROM u), (SELECT unnest(range(0, 4)) AS block_index)),
b AS (SELECT m.doc_id, block_index, m.source, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(score) AS w FROM m JOIN u ON u.doc_id = m.doc_id AND u.source = m.source AND position >= first AND position < end_ GROUP BY 1, 2, 3, 4),
v AS (SELECT doc_id, block_index, page, count(DISTINCT source) AS sources, sum(w) AS s FROM b GROUP BY 1, 2, 3), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_index ORDER BY sources DESC, round(s, 9) DESC, page) AS n FROM v) WHERE n = 1), k AS (SELECT b.* FROM b JOIN p USING (doc_id, block_index, page)),
x AS (SELECT doc_id, block_index, {", ".join(f"min({c}) AS {c}" for c in ("x0", "y0", "x1", "y1"))} FROM k GROUP BY 1, 2) SELECT doc_id, block_index, page, sources, x.x0, x.y0, x.x1, x.y1 FROM p JOIN x USING (doc_id, block_index)""")
def consensus_boxes(spark, sf_dir):
    """A block's page and box over its sources; as each page is one source's here, medians are the source's own corners."""
    rows = units(spark, sf_dir)
    b = F.col("block_index")
    matches = rows.select("doc_id", "source").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block_index")).select("doc_id", "source", "block_index", (b * 2).alias("first"), (b * 2 + 2).alias("end"), (0.75 + (b % 2) / 8).alias("score"))
    return alignment.consensus_boxes(matches, rows)


SAID = ["so $x+1$ holds", "pay $5 and $6", "$a$ then $b$", r"cost \\$4 or $ 3$", "none", "$$x$$ $y$2 $z$"]


@query(f"SELECT p_partkey, {[1, 0, 2, 0, 0, 1]}[p_partkey % 6 + 1]::BIGINT AS formulas FROM part")
def inline_formulas(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", t.math_count(said).cast("long").alias("formulas"))
