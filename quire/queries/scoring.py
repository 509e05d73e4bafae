"""Composite scores, run records and checks of cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import LINES_SQL, OBS_SQL, RUNS_SQL, lines, observations, runs, table
from ..operators import metrics, scoring, sequences
from ..registry import query


@query(f"""WITH {OBS_SQL}, r AS (SELECT page_id, kind, count(*) AS r FROM obs WHERE source = 'src0' GROUP BY 1, 2), c AS (SELECT page_id, kind, count(*) AS c FROM obs WHERE source = 'src1' GROUP BY 1, 2),
b AS (SELECT page_id, sum(least(coalesce(r, 0), coalesce(c, 0))) AS m, sum(coalesce(r, 0)) AS r, sum(coalesce(c, 0)) AS c FROM r FULL JOIN c USING (page_id, kind) GROUP BY 1), q AS (SELECT *, CASE WHEN c > 0 THEN m / c ELSE (r = 0)::INT END AS p, CASE WHEN r > 0 THEN m / r ELSE (c = 0)::INT END AS q FROM b),
t AS (SELECT page_id, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS type_f1 FROM q),
a AS (SELECT page_id, element_id AS r, row_number() OVER (PARTITION BY page_id ORDER BY y0, x1, element_id) AS c FROM obs), o AS (SELECT page_id, coalesce(s, 1) AS order_accuracy FROM (SELECT DISTINCT page_id FROM a) LEFT JOIN (SELECT x.page_id, count(*) FILTER (x.c < y.c) / count(*) AS s FROM a x JOIN a y ON x.page_id = y.page_id AND x.r < y.r GROUP BY 1) USING (page_id)),
h AS (SELECT page_id, avg((page_id % 3 = 0 OR element_id % 2 = 0)::INT) AS relationship_accuracy FROM obs GROUP BY 1), g AS (SELECT DISTINCT page_id, (page_id % 11) / 10 AS table_accuracy FROM obs WHERE page_id % 2 = 0),
z AS (SELECT page_id, coalesce(type_f1, 1) AS type_f1, coalesce(order_accuracy, 1) AS order_accuracy, coalesce(relationship_accuracy, 1) AS relationship_accuracy, coalesce(table_accuracy, 1) AS table_accuracy FROM o LEFT JOIN t USING (page_id) LEFT JOIN h USING (page_id) LEFT JOIN g USING (page_id))
SELECT page_id, round(type_f1, 9) AS type_f1, round(order_accuracy, 9) AS order_accuracy, round(relationship_accuracy, 9) AS relationship_accuracy, round(table_accuracy, 9) AS table_accuracy,
  round(greatest(0, least(1, 0.40 * type_f1 + 0.25 * order_accuracy + 0.20 * relationship_accuracy + 0.15 * table_accuracy)), 6) AS structure_score FROM z""")
def structure_scores(spark, sf_dir):
    from pyspark.sql import Window

    rows, e = observations(spark, sf_dir), F.col("element_id")
    types = metrics.type_f1(rows.where("source = 'src0'"), rows.where("source = 'src1'"), ["page_id"])
    order = sequences.concordance(rows.withColumn("c", F.row_number().over(Window.partitionBy("page_id").orderBy("y0", "x1", "element_id"))), "page_id", "element_id", "c")
    # One relationship an element (its parent), with another value in the candidate where page and element say so.
    same = (F.col("page_id") % 3 == 0) | (e % 2 == 0)
    pairs = rows.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct(e.cast("string").alias("k"), F.lit("p").alias("v")))).alias("a"), F.map_from_entries(F.collect_list(F.struct(e.cast("string").alias("k"), F.when(same, "p").otherwise("q").alias("v")))).alias("b"))
    hierarchy = metrics.relationship_accuracy(pairs, ["page_id"], "a", "b")
    tables = rows.where("page_id % 2 = 0").select("page_id", ((F.col("page_id") % 11) / 10).alias("table_accuracy")).distinct()
    out = scoring.structure_metrics(types, order, hierarchy, tables, ["page_id"])
    return out.select("page_id", *[F.round(c, 9).alias(c) for c in ("type_f1", "order_accuracy", "relationship_accuracy", "table_accuracy")], F.round("structure_score", 6).alias("structure_score"))


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 1.0 END AS text, CASE WHEN event_id % 4 <> 0 THEN 1.0 END AS layout, 1.0 AS structure, CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 1.0 END AS editability, CASE WHEN event_id % 7 <> 0 THEN 1.0 END AS visual FROM events)
SELECT event_id, (text IS NOT NULL)::INT + (layout IS NOT NULL)::INT + 2 + (visual IS NOT NULL)::INT AS measured, coalesce(text = 1 AND layout = 1 AND structure = 1 AND editability = 1 AND visual = 1, false) AS accepted FROM c""")
def acceptance(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, F.when(e % 3 != 0, 1.0).alias("text"), F.when(e % 4 != 0, 1.0).alias("layout"), F.lit(1.0).alias("structure"), F.when(e % 5 == 0, 0.5).otherwise(1.0).alias("editability"), F.when(e % 7 != 0, 1.0).alias("visual"))
    return scoring.accepted(rows).select("event_id", "measured", "accepted")


@query("""WITH e AS (SELECT conv_id, turn % 3 AS page, CASE WHEN turn % 4 <> 0 THEN 100 - turn END AS ro, turn, text FROM conversations), p AS (SELECT conv_id, page, coalesce(string_agg(text, chr(10) ORDER BY ro IS NULL, coalesce(ro, 0), turn, text) FILTER (text <> ''), '') AS t FROM e GROUP BY 1, 2)
SELECT conv_id, string_agg(t, chr(12) ORDER BY page) AS document_text FROM p GROUP BY 1""")
def document_texts(spark, sf_dir):
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", (t % 3).alias("page"), F.when(t % 4 != 0, 100 - t).alias("reading_order"), t.alias("position"), "text")
    return scoring.page_texts(rows, "conv_id", "page")


PRINT = """sha256('{"case_id":"' || case_id || '","event_type":"' || event_type || '","system":"' || system || '"}')"""


@query(f"""WITH {RUNS_SQL}, c AS (SELECT case_id, {PRINT} AS fingerprint FROM runs), r AS (SELECT case_id, CASE WHEN case_id % 5 = 0 THEN 'old' ELSE fingerprint END AS fingerprint, case_id % 4 <> 0 AS succeeded, case_id % 7 AS a, case_id % 3 AS b FROM c WHERE case_id % 2 = 0)
SELECT case_id, fingerprint FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.case_id = c.case_id AND r.fingerprint = c.fingerprint AND (NOT succeeded OR a = b))""")
def pending_cases(spark, sf_dir):
    cases = runs(spark, sf_dir)
    cases = cases.select("case_id", scoring.case_fingerprints(cases, "system", "event_type", "case_id").alias("fingerprint"))
    i = F.col("case_id")
    records = cases.where(i % 2 == 0).select(i, F.when(i % 5 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), (i % 4 != 0).alias("succeeded"), (i % 7).alias("recorded_sha"), (i % 3).alias("output_sha"))
    return scoring.pending(cases, records)


@query(f"""WITH {RUNS_SQL}, c AS (SELECT case_id, {PRINT} AS f, CASE WHEN case_id % 9 <> 0 THEN score END AS score, CASE WHEN case_id % 9 <> 0 AND status = 'crash' THEN 'Error: crash' END AS error FROM runs)
SELECT case_id, CASE WHEN error IS NULL AND score IS NOT NULL THEN f ELSE sha256(case_id::VARCHAR) END AS fingerprint, CASE WHEN error IS NULL THEN score END AS score, CASE WHEN error IS NOT NULL OR score IS NULL THEN coalesce(error, 'no result') END AS error FROM c""")
def case_records(spark, sf_dir):
    rows = runs(spark, sf_dir)
    cases = rows.select("case_id", scoring.case_fingerprints(rows, "system", "event_type", "case_id").alias("fingerprint"))
    results = rows.where("case_id % 9 <> 0").select("case_id", "score", F.when(F.col("status") == "crash", "Error: crash").alias("error"))
    return scoring.run_cases(cases, results).select("case_id", "fingerprint", "score", "error")


SAID = ["ok", "CUDA out of memory", "Segmentation fault (core dumped)", "oom-killer", "bad input", "cannot allocate memory", ""]
CODES = [0, 1, 137, -9, -11, 2, 139, -6, 1]


@query(f"""WITH e AS (SELECT event_id, event_id % 13 = 0 AS late, {CODES}[event_id % 9 + 1] AS code, {SAID}[event_id % 7 + 1] AS said FROM events)
SELECT event_id, CASE WHEN late THEN 'timeout' WHEN code IN (137, -9) OR regexp_matches(said, '(?i)out of memory|oom|cannot allocate memory') THEN 'oom' WHEN code < 0 OR regexp_matches(said, '(?i)segmentation fault|core dumped') THEN 'crash' ELSE 'nonzero_exit' END AS status FROM e""")
def failure_statuses(spark, sf_dir):
    e = F.col("event_id")
    code, said = F.element_at(F.array(*map(F.lit, CODES)), (e % 9 + 1).cast("int")), F.element_at(F.array(*map(F.lit, SAID)), (e % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(e, scoring.failure_status(e % 13 == 0, code, said).alias("status"))


ANNOTATED = f"""{LINES_SQL}, a AS (SELECT l_orderkey AS page, l_linenumber AS idx, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'a' || (l_partkey % 12) END AS anno_id, CASE WHEN l_suppkey % 8 <> 0 THEN l_suppkey % 3 = 0 END AS ignored, CASE WHEN l_suppkey % 4 <> 0 THEN l_partkey % 10 - 1 END AS ord FROM lines),
f AS (SELECT page, idx, ignored, CASE WHEN trim(anno_id) = '' THEN 'invalid_annotation_id' WHEN row_number() OVER (PARTITION BY page, anno_id ORDER BY idx) > 1 THEN 'duplicate_annotation_id' WHEN ignored IS NULL THEN 'invalid_ignore_flag' WHEN ord < 0 THEN 'invalid_reading_order'
  WHEN ord IS NOT NULL AND row_number() OVER (PARTITION BY page, ord ORDER BY idx) > 1 THEN 'duplicate_reading_order' END AS fault FROM a)"""


@query(f"WITH {ANNOTATED} SELECT page, idx AS \"index\", fault, fault IS NULL AND NOT ignored AS retained FROM f")
def annotation_partition(spark, sf_dir):
    """Which annotations are at fault, and which of the others are kept."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("index"), F.when(p % 9 == 0, " ").otherwise(F.concat(F.lit("a"), (p % 12).cast("string"))).alias("anno_id"), F.when(s % 8 != 0, s % 3 == 0).alias("ignored"), F.when(s % 4 != 0, p % 10 - 1).alias("order"))
    return scoring.annotation_faults(rows, "page").select("page", "index", "fault", (F.col("fault").isNull() & ~F.col("ignored")).alias("retained"))


@query(f"""WITH {OBS_SQL}, n AS (SELECT page_id, count(*) FILTER (element_id % 4 <> 0) AS retained, count(*) FILTER (element_id % 4 = 0) AS ignored, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM obs GROUP BY 1),
p AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 150.0 WHEN 1 THEN 170.0 WHEN 2 THEN 150.3 ELSE 99.0 END AS w, CASE page_id % 4 WHEN 1 THEN 150.0 WHEN 3 THEN 99.0 ELSE 170.0 END AS h, 150 AS rw, 170 AS rh FROM n),
q AS (SELECT *, abs(w - rw) <= 0.5 AND abs(h - rh) <= 0.5 AS same, abs(w - rh) <= 0.5 AND abs(h - rw) <= 0.5 AS turned FROM p)
SELECT page_id, retained, ignored, CASE WHEN NOT same AND NOT turned THEN 'reported_dimensions_incompatible' WHEN x0 < -1 OR y0 < -1 OR x1 > rw + 1 OR y1 > rh + 1 THEN 'annotation_out_of_bounds' WHEN same THEN 'dimensions_match' ELSE 'reported_dimensions_transposed' END AS reason, NOT same AND turned AS corrected FROM q""")
def projection_checks(spark, sf_dir):
    k = F.col("page_id") % 4
    rows = observations(spark, sf_dir).withColumn("ignored", F.col("element_id") % 4 == 0)
    pages = rows.select("page_id").distinct().select("page_id", F.when(k == 0, 150.0).when(k == 1, 170.0).when(k == 2, 150.3).otherwise(99.0).alias("width"), F.when(k == 1, 150.0).when(k == 3, 99.0).otherwise(170.0).alias("height"), F.lit(150).alias("raster_width"), F.lit(170).alias("raster_height"))
    return scoring.projection_checks(pages, rows, "page_id")


@query(f"""WITH {LINES_SQL}, p AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS i, l_suppkey % 5 AS j, (l_partkey % 21) / 20 AS shape, (l_suppkey % 19) / 18 AS area, l_quantity / 50 AS position, l_discount * 10 AS overlap FROM lines)
SELECT l_orderkey, l_linenumber, round(greatest(0, 1 - (0.50 * shape + 0.30 * area + 0.20 * position)), 9) AS cost FROM p WHERE i = j OR (shape >= 0.55 AND area >= 0.50 AND position >= 0.65) OR (overlap >= 0.35 AND shape >= 0.35 AND area >= 0.35)""")
def component_costs(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array((p % 5).cast("string")).alias("ids"), F.array((s % 5).cast("string")).alias("ids2"), ((p % 21) / 20).alias("shape"), ((s % 19) / 18).alias("area"), (F.col("l_quantity") / 50).alias("position"), (F.col("l_discount") * 10).alias("overlap"))
    return scoring.component_costs(rows).select("l_orderkey", "l_linenumber", F.round("cost", 9).alias("cost"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT page_id, element_id AS component_id, x0, y0, x1, y1 FROM obs WHERE element_id % 2 = 1), r AS (SELECT page_id, CASE WHEN element_id % 4 = 0 THEN 'Obj' ELSE 'obj' END || (element_id % 5) AS object_id, x0 + 20 AS x0, y0 + 10 AS y0, x1 + 20 AS x1, y1 + 10 AS y1 FROM obs),
m AS (SELECT DISTINCT c.page_id, component_id, object_id FROM c JOIN r USING (page_id) WHERE greatest(0, least(c.x1, r.x1) - greatest(c.x0, r.x0)) * greatest(0, least(c.y1, r.y1) - greatest(c.y0, r.y0)) / least((c.x1 - c.x0) * (c.y1 - c.y0), (r.x1 - r.x0) * (r.y1 - r.y0)) >= 0.10)
SELECT c.page_id, c.component_id, coalesce(string_agg(object_id, ',' ORDER BY lower(object_id), object_id), '') AS objects FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.component_id = c.component_id GROUP BY 1, 2""")
def component_objects(spark, sf_dir):
    rows, e = observations(spark, sf_dir), F.col("element_id")
    components = rows.where(e % 2 == 1).select("page_id", e.alias("component_id"), "x0", "y0", "x1", "y1")
    regions = rows.select("page_id", F.concat(F.when(e % 4 == 0, "Obj").otherwise("obj"), (e % 5).cast("string")).alias("object_id"), *[(F.col(c) + d).alias(c) for c, d in (("x0", 20), ("y0", 10), ("x1", 20), ("y1", 10))])
    return scoring.object_ids(components, regions, "page_id").select("page_id", "component_id", F.array_join("objects", ",").alias("objects"))


@query(f"""WITH {LINES_SQL}, p AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 = 0 AS ids, (l_partkey % 21) / 20 AS shape, (l_suppkey % 11 + 9) / 19 AS area, l_discount * 10 AS overlap, l_tax / 8 AS dx, l_discount / 20 AS dy, least(1.0, l_quantity / 30) AS wr, 1.0 AS hr, l_tax * 10 AS missing, l_discount * 5 AS extra FROM lines),
q AS (SELECT *, sqrt(dx * dx + dy * dy) AS moved FROM p), s AS (SELECT *, moved >= 0.008 AND (shape >= 0.45 OR ids) AS d, least(wr, hr, area) < 0.80 AND (shape >= 0.40 OR ids) AS z FROM q)
SELECT l_orderkey, l_linenumber, kind, round(greatest(0, least(1, severity)), 9) AS severity FROM (
  SELECT *, 'displaced_region' AS kind, 0.65 * least(1.0, moved / 0.20) + 0.35 * (1 - overlap) AS severity FROM s WHERE d UNION ALL SELECT *, 'size_mismatch', 1 - (0.45 * area + 0.30 * wr + 0.25 * hr) FROM s WHERE z
  UNION ALL SELECT *, 'missing_region', 0.15 + 0.85 * sqrt(missing) FROM s WHERE NOT d AND NOT z AND missing >= 0.15 UNION ALL SELECT *, 'extra_region', 0.15 + 0.85 * sqrt(extra) FROM s WHERE NOT d AND NOT z AND missing < 0.15 AND extra >= 0.15)""")
def render_diagnostics(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", (p % 4 == 0).alias("has_ids"), ((p % 21) / 20).alias("shape"), ((s % 11 + 9) / 19).alias("area"), (F.col("l_discount") * 10).alias("overlap"), (F.col("l_tax") / 8).alias("dx"), (F.col("l_discount") / 20).alias("dy"), F.least(F.lit(1.0), F.col("l_quantity") / 30).alias("width_ratio"), F.lit(1.0).alias("height_ratio"), (F.col("l_tax") * 10).alias("missing"), (F.col("l_discount") * 5).alias("extra"))
    return scoring.render_diagnostics(rows).select("l_orderkey", "l_linenumber", "kind", F.round("severity", 9).alias("severity"))


@query("""WITH p AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '!' WHEN 2 THEN '' ELSE replace(p_name, 'e', 'E') END AS b FROM part)
SELECT p_partkey, CASE WHEN a = b THEN NULL ELSE coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(length(a), length(b))) END AS differs_at FROM p""")
def projection_differences(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit("!"))).when(k == 2, "").otherwise(F.replace(name, F.lit("e"), F.lit("E")))
    return table(spark, sf_dir, "part").select("p_partkey", scoring.first_difference(name, other).cast("long").alias("differs_at"))
