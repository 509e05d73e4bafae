"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import LINES_SQL, OBS_SQL, READ_SQL, RUNS_SQL, lines, observations, readings, runs, table
from .functions import geometry as g
from .functions import ids
from .functions import text as t
from .operators import benchmarks, consensus, governance, graphs, markup, matching, metrics, routing, sequences
from .plans import fusion
from .queries import documents, evidence, frames, payloads, results, revision, scoring, topology  # noqa: F401
from .registry import QUERIES, SQL, query
from .sources import sinks, sniff

# Governance


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    return governance.assign_splits(rows.select(F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("group_id"), F.sha2("text", 256).alias("digest"), "label", "lang", "source"))


SPLIT_SQL = """samples AS (SELECT doc_id AS sample_id, sha256(text) AS digest, quality AS label, lang, source,
  CASE WHEN v < 80 THEN 'train' WHEN v < 90 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT d.*, l.quality, ('0x' || substr(sha256('0:' || d.doc_id), 1, 8))::BIGINT % 100 AS v FROM documents d LEFT JOIN labels l USING (doc_id)))"""


@query(f"""WITH {SPLIT_SQL},
shared AS (SELECT digest, count(*) AS copies, count(DISTINCT split) AS splits FROM samples GROUP BY 1 HAVING count(*) > 1)
SELECT split, lang, count(*) AS n_samples, count(label) AS n_labelled, count(*) FILTER (copies > 1) AS n_duplicate, count(*) FILTER (splits > 1) AS n_leaking
FROM samples LEFT JOIN shared USING (digest) GROUP BY 1, 2""")
def dataset_audit(spark, sf_dir):
    return governance.audit(samples(spark, sf_dir), ["lang"])


@query(f"WITH {SPLIT_SQL} SELECT digest, copies, sample_id FROM (SELECT digest, sample_id, count(*) OVER (PARTITION BY digest) AS copies FROM samples WHERE digest IS NOT NULL) WHERE copies > 1")
def duplicate_digests(spark, sf_dir):
    return governance.duplicate_digests(samples(spark, sf_dir))


@query(f"WITH {SPLIT_SQL} SELECT digest, count(DISTINCT split) AS n_splits, count(*) AS n_samples FROM samples WHERE digest IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_groups(spark, sf_dir):
    return governance.leakage(samples(spark, sf_dir), "digest")


RIGHTS_SQL = """SELECT doc_id AS sample_id, coalesce(
  CASE WHEN lane = 'unknown' THEN 'usage lane is unknown' END, CASE WHEN lane <> 'commercial-permissive' THEN 'excluded from commercial training' END,
  CASE WHEN NOT commercial OR license = '' THEN 'commercial rights are not explicit' END,
  CASE WHEN pii IN ('pii', 'contains-pii', 'secret') AND consent = '' THEN 'personal data without consent scope' END) AS rights_error
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'research-only' ELSE 'commercial-permissive' END AS lane, doc_id % 7 <> 0 AS commercial,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'MIT' END AS license, CASE WHEN doc_id % 4 = 0 THEN 'pii' ELSE 'none' END AS pii, CASE WHEN doc_id % 8 = 0 THEN 'training' ELSE '' END AS consent FROM documents)"""


@query(RIGHTS_SQL)
def rights_errors(spark, sf_dir):
    d = F.col("doc_id")
    lane = F.when(d % 5 == 0, "unknown").when(d % 5 == 1, "research-only").otherwise("commercial-permissive")
    error = governance.rights_error(lane, "commercial-permissive", d % 7 != 0, F.when(d % 11 == 0, "").otherwise("MIT"), F.when(d % 4 == 0, "PII").otherwise("none"), F.when(d % 8 == 0, "training").otherwise(""))
    return table(spark, sf_dir, "documents").select(d.alias("sample_id"), error.alias("rights_error"))


@query(f"""WITH r AS (SELECT sha256('=' || doc_id || chr(31) || '=' || lang || chr(31) || coalesce('=' || source, '~')) AS d FROM documents)
SELECT count(*) AS n_rows, sha256(count(*) || ',' || {" || ',' || ".join(f"sum(('0x' || substr(d, {8 * k + 1}, 8))::BIGINT)" for k in range(8))}) AS fingerprint FROM r""")
def dataset_fingerprint(spark, sf_dir):
    return ids.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "lang", "source")


@query("SELECT * FROM (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM benchmark) WHERE ordinal % 3 = 1")
def case_shard(spark, sf_dir):
    return governance.shard_cases(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", 1, 3)


# Consensus


@query(f"""WITH {OBS_SQL}, k AS (SELECT page_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, count(DISTINCT source) AS votes, round(sum(coalesce(confidence, 0.5)), 9) AS s, max(coalesce(confidence, 0.5)) AS m, min(length(text)) AS l FROM obs GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY votes DESC, s DESC, m DESC, l, key) AS n FROM k),
c AS (SELECT o.page_id, o.text, w.votes, row_number() OVER (PARTITION BY o.page_id ORDER BY coalesce(confidence, 0.5) DESC, source, text) AS n FROM obs o JOIN w ON o.page_id = w.page_id AND w.n = 1 AND lower(trim(regexp_replace(o.text, '\\s+', ' ', 'g'))) = w.key)
SELECT page_id, text AS chosen_text, votes FROM c WHERE n = 1""")
def chosen_text(spark, sf_dir):
    return consensus.choose_text(observations(spark, sf_dir), ["page_id"])


@query(f"WITH {OBS_SQL} SELECT page_id, round(CASE WHEN count(confidence) > 0 THEN 1 - coalesce(product(1 - confidence), 1) END, 9) AS confidence FROM obs GROUP BY 1")
def noisy_or_confidence(spark, sf_dir):
    return consensus.noisy_or(observations(spark, sf_dir), ["page_id"]).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH {OBS_SQL}, v AS (SELECT page_id, kind, round(sum(coalesce(confidence, 0.5) * CASE WHEN kind = 'unknown' THEN 0.25 ELSE 1 END), 9) AS w FROM obs GROUP BY 1, 2)
SELECT page_id, kind, round(weight, 6) AS weight FROM (SELECT page_id, kind, w AS weight, row_number() OVER (PARTITION BY page_id ORDER BY w DESC, kind = 'unknown', kind) AS n FROM v) WHERE n = 1""")
def chosen_type(spark, sf_dir):
    return consensus.choose_type(observations(spark, sf_dir), ["page_id"]).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {OBS_SQL}, w AS (SELECT *, greatest(coalesce(confidence, 0.5), 0.01) AS w FROM obs)
SELECT page_id, {", ".join(f"round(sum({c} * w) / sum(w), 6) AS {c}" for c in ("x0", "y0", "x1", "y1"))} FROM w GROUP BY 1""")
def fused_boxes(spark, sf_dir):
    out = consensus.fuse_boxes(observations(spark, sf_dir), ["page_id"])
    return out.select("page_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""WITH {OBS_SQL}, s AS (SELECT page_id, x1, sum(coalesce(confidence, 0.5)) AS w FROM obs GROUP BY 1, 2),
r AS (SELECT *, round(sum(w) OVER (PARTITION BY page_id), 9) AS total, round(sum(w) OVER (PARTITION BY page_id ORDER BY x1), 9) AS run FROM s)
SELECT page_id, min(x1) AS median FROM r WHERE run * 2 >= total GROUP BY 1""")
def weighted_median_edge(spark, sf_dir):
    return consensus.weighted_median(observations(spark, sf_dir), ["page_id"], "x1")


@query(f"""WITH {OBS_SQL}, s AS (SELECT *, CASE WHEN element_id % 2 = 0 THEN 'font' || (x0::INT % 3) END AS font, CASE WHEN element_id % 3 = 0 THEN y1 END AS size FROM obs)
SELECT DISTINCT page_id, first_value(font) OVER (PARTITION BY page_id ORDER BY font IS NULL, coalesce(confidence, 0.5) DESC, source, element_id) AS font,
  first_value(size) OVER (PARTITION BY page_id ORDER BY size IS NULL, coalesce(confidence, 0.5) DESC, source, element_id) AS size FROM s""")
def fused_style(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumns({"font": F.when(F.col("element_id") % 2 == 0, F.concat(F.lit("font"), (F.col("x0").cast("int") % 3).cast("string"))), "size": F.when(F.col("element_id") % 3 == 0, F.col("y1"))})
    return consensus.first_known(rows, ["page_id"], ["font", "size"], ["source", "element_id"])


@query(f"WITH {OBS_SQL} SELECT page_id, source, text, max(confidence) AS confidence, count(*) AS seen FROM obs GROUP BY ALL")
def text_candidates(spark, sf_dir):
    return consensus.distinct_candidates(observations(spark, sf_dir), ["page_id"])


@query(f"""WITH {OBS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id, text, kind, round(x0 / 40), y0 ORDER BY element_id) AS n FROM obs)
SELECT page_id, element_id, row_number() OVER (PARTITION BY page_id ORDER BY element_id) - 1 AS reading_order FROM k WHERE n = 1""")
def unique_elements(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumns({"x0": F.round(F.col("x0") / 40), "x1": F.lit(0.0), "y1": F.lit(0.0)})
    return consensus.unique_elements(rows, "page_id", ["element_id"]).select("page_id", "element_id", "reading_order")


@query(f"""WITH {OBS_SQL}, s AS (SELECT page_id, CASE kind WHEN 'title' THEN 'native' WHEN 'text' THEN 'scanned' ELSE 'image' END AS t FROM obs)
SELECT page_id, CASE WHEN bool_or(t = 'native') AND (bool_or(t = 'scanned') OR bool_or(t = 'image')) THEN 'hybrid' WHEN bool_or(t = 'native') THEN 'native' WHEN bool_or(t = 'scanned') THEN 'scanned' ELSE 'image' END AS source_type FROM s GROUP BY 1""")
def fused_source_type(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("source_type", F.when(F.col("kind") == "title", "native").when(F.col("kind") == "text", "scanned").otherwise("image"))
    return consensus.source_type(rows, ["page_id"])


@query(f"""WITH {LINES_SQL}, e AS (SELECT 's' || (l_suppkey % 2) AS source, l_orderkey * 100 + l_linenumber AS src, 'next' AS kind, l_linenumber AS ordinal, l_orderkey * 100 + l_linenumber + 1 AS dst FROM lines),
m AS (SELECT DISTINCT source, src AS element_id, l.l_orderkey * 100 + (l.l_linenumber // 2) AS fused_id FROM e JOIN lines l ON e.src = l.l_orderkey * 100 + l.l_linenumber)
SELECT a.fused_id AS src, kind, b.fused_id AS dst, min(ordinal) AS ordinal FROM e JOIN m a ON a.source = e.source AND a.element_id = e.src JOIN m b ON b.source = e.source AND b.element_id = e.dst WHERE a.fused_id <> b.fused_id GROUP BY ALL""")
def remapped_relationships(spark, sf_dir):
    at = lines(spark, sf_dir)
    src = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    source = F.concat(F.lit("s"), (F.col("l_suppkey") % 2).cast("string")).alias("source")
    edges = at.select(source, src.alias("src"), F.lit("next").alias("kind"), F.col("l_linenumber").alias("ordinal"), (src + 1).alias("dst"))
    mapping = at.select(source, src.alias("element_id"), (F.col("l_orderkey") * 100 + F.floor(F.col("l_linenumber") / 2)).alias("fused_id")).distinct()
    return consensus.remap_edges(edges, mapping)


# Matching


IOU_SQL = """CASE WHEN w > 0 AND h > 0 THEN w * h / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h) ELSE 0 END"""
PAIRS_SQL = f"""{OBS_SQL}, met AS (SELECT a.page_id, a.element_id, b.element_id AS element_id2, a.source, b.source AS source2, {IOU_SQL} AS iou FROM
  (SELECT a, b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h FROM obs a JOIN obs b ON a.page_id = b.page_id AND a.source < b.source
   AND (a.kind = b.kind OR (a.kind <> 'unknown' AND b.kind <> 'unknown') OR a.kind = 'unknown' OR b.kind = 'unknown')))"""


@query(f"WITH {PAIRS_SQL} SELECT page_id, element_id, element_id2, round(iou, 9) AS iou FROM met WHERE iou >= 0.1")
def correlated_pairs(spark, sf_dir):
    return matching.correlated_pairs(observations(spark, sf_dir), least=0.1).select("page_id", "element_id", "element_id2", F.round("iou", 9).alias("iou"))


@query(f"WITH {PAIRS_SQL} SELECT page_id, element_id, source FROM obs o WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.iou >= 0.1 AND m.page_id = o.page_id AND o.element_id IN (m.element_id, m.element_id2))")
def unmatched_elements(spark, sf_dir):
    return matching.unmatched(observations(spark, sf_dir), least=0.1).select("page_id", "element_id", "source")


@query(f"""WITH {OBS_SQL}, l AS (SELECT page_id, element_id AS line_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x0, y0, x1, y1 FROM obs WHERE kind = 'text'), b AS (SELECT * FROM obs WHERE kind <> 'text'),
m AS (SELECT l.page_id, line_id, b.element_id AS block_id, row_number() OVER (PARTITION BY l.page_id, line_id ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.element_id) AS n FROM l JOIN b ON l.page_id = b.page_id AND cx BETWEEN b.x0 AND b.x1 AND cy BETWEEN b.y0 AND b.y1
  AND least(l.x1, b.x1) > greatest(l.x0, b.x0) AND least(l.y1, b.y1) > greatest(l.y0, b.y0))
SELECT l.page_id, l.line_id, m.block_id FROM l LEFT JOIN m ON l.page_id = m.page_id AND l.line_id = m.line_id AND m.n = 1""")
def containing_blocks(spark, sf_dir):
    rows = observations(spark, sf_dir)
    lines = rows.where("kind = 'text'").select("page_id", F.col("element_id").alias("line_id"), "x0", "y0", "x1", "y1")
    blocks = rows.where("kind <> 'text'").select("page_id", F.col("element_id").alias("block_id"), "x0", "y0", "x1", "y1")
    return matching.containing_block(lines, blocks, "page_id").select("page_id", "line_id", "block_id")


@query(f"""WITH {OBS_SQL}, c AS (SELECT * FROM obs WHERE kind = 'title'), f AS (SELECT * FROM obs WHERE kind = 'unknown'),
m AS (SELECT c.page_id, c.element_id AS item_id, f.element_id AS target_id, row_number() OVER (PARTITION BY c.page_id, c.element_id
  ORDER BY greatest(0, c.y0 - f.y1, f.y0 - c.y1), abs(c.x0 + c.x1 - f.x0 - f.x1) / 2, f.element_id) AS n
  FROM c JOIN f ON c.page_id = f.page_id AND greatest(0, least(c.x1, f.x1) - greatest(c.x0, f.x0)) / least(c.x1 - c.x0, f.x1 - f.x0) >= 0.25)
SELECT c.page_id, c.element_id AS item_id, m.target_id FROM c LEFT JOIN m ON c.page_id = m.page_id AND c.element_id = m.item_id AND n = 1""")
def caption_targets(spark, sf_dir):
    rows = observations(spark, sf_dir)
    pick = lambda kind, name: rows.where(F.col("kind") == kind).select("page_id", F.col("element_id").alias(name), "x0", "y0", "x1", "y1")
    return matching.nearest_above(pick("title", "item_id"), pick("unknown", "target_id"), "page_id").select("page_id", "item_id", "target_id")


@query(f"""WITH {LINES_SQL}, a AS (SELECT l_orderkey AS doc_id, l_linenumber AS number FROM lines), b AS (SELECT doc_id, number + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS number FROM a WHERE NOT (doc_id % 5 = 0 AND number = 2)),
k AS (SELECT doc_id, list_sort(list(number)) AS la FROM a GROUP BY 1), l AS (SELECT doc_id, list_sort(list(number)) AS lb FROM b GROUP BY 1),
j AS (SELECT doc_id, la[1] AS fa, lb[1] AS fb, len(la) = len(lb) AND la[-1] - la[1] + 1 = len(la) AND lb[-1] - lb[1] + 1 = len(lb) AND la <> lb AS by_place FROM k JOIN l USING (doc_id))
SELECT a.doc_id, a.number, b.number AS number2, by_place FROM a JOIN j USING (doc_id) JOIN b ON a.doc_id = b.doc_id AND b.number = CASE WHEN by_place THEN a.number - fa + fb ELSE a.number END""")
def bound_pages(spark, sf_dir):
    a = lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("number"))
    b = a.where("not (doc_id % 5 = 0 and number = 2)").select("doc_id", (F.col("number") + F.when(F.col("doc_id") % 2 == 0, 3).otherwise(0)).alias("number"))
    return matching.bind_pages(a, b)


@query(f"""WITH {READ_SQL}, w AS (SELECT *, coalesce(confidence, 0.5) AS w, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM reads), k AS (SELECT page_id, slot, odd, row_number() OVER (PARTITION BY page_id ORDER BY min(y0), min(x0), min(source)) - 1 AS cluster, count(DISTINCT source) AS sources,
  {", ".join(f"sum({c} * greatest(w, 0.01)) / sum(greatest(w, 0.01)) AS {c}" for c in ("x0", "y0", "x1", "y1"))}, CASE WHEN count(confidence) > 0 THEN 1 - coalesce(product(1 - confidence), 1) END AS confidence FROM w GROUP BY 1, 2, 3),
t AS (SELECT page_id, slot, odd, kind FROM (SELECT page_id, slot, odd, kind, row_number() OVER (PARTITION BY page_id, slot, odd ORDER BY round(sum(w * CASE WHEN kind = 'unknown' THEN 0.25 ELSE 1 END), 9) DESC, kind = 'unknown', kind) AS n FROM w GROUP BY 1, 2, 3, 4) WHERE n = 1),
v AS (SELECT page_id, slot, odd, key, count(DISTINCT source) AS votes, row_number() OVER (PARTITION BY page_id, slot, odd ORDER BY count(DISTINCT source) DESC, round(sum(w), 9) DESC, max(w) DESC, min(length(text)), key) AS n FROM w GROUP BY 1, 2, 3, 4),
b AS (SELECT w.page_id, w.slot, w.odd, text AS chosen_text, votes, row_number() OVER (PARTITION BY w.page_id, w.slot, w.odd ORDER BY w.w DESC, source, text) AS n FROM w JOIN v ON v.page_id = w.page_id AND v.slot = w.slot AND v.odd = w.odd AND v.key = w.key AND v.n = 1)
SELECT k.page_id, cluster, row_number() OVER (PARTITION BY k.page_id ORDER BY y0, x0, cluster) - 1 AS reading_order, t.kind, chosen_text, votes, sources, {", ".join(f"round({c}, 6) AS {c}" for c in ("x0", "y0", "x1", "y1", "confidence"))}
FROM k JOIN t ON t.page_id = k.page_id AND t.slot = k.slot AND t.odd = k.odd JOIN b ON b.page_id = k.page_id AND b.slot = k.slot AND b.odd = k.odd AND b.n = 1""")
def fused_pages(spark, sf_dir):
    """Clusters by place, type and text, and every reducer. SQL knows the clusters from how the readings are made."""
    out = fusion.fuse(readings(spark, sf_dir))
    return out.select("page_id", "cluster", "reading_order", "kind", "chosen_text", "votes", "sources", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "confidence")])


@query()
def matched_elements(spark, sf_dir):
    """Two sources of each page against each other; held against all possible assignments in the tests."""
    rows = observations(spark, sf_dir).withColumn("reading_order", F.col("element_id"))
    sides = rows.where("source in ('src0', 'src1')").withColumn("side", F.when(F.col("source") == "src0", 0).otherwise(1))
    return matching.match_sides(sides, 160.0, 200.0).withColumn("cost", F.round("cost", 9))


# Sequences


@query(f"""WITH {OBS_SQL}, s AS (SELECT *, CASE WHEN x1 - x0 >= 0.62 * 160 OR (x0 < 80 AND x1 > 80) THEN 'full' WHEN (x0 + x1) / 2 < 80 THEN 'left' ELSE 'right' END AS side FROM obs),
p AS (SELECT *, count(*) FILTER (side = 'left') OVER w >= 2 AND count(*) FILTER (side = 'right') OVER w >= 2 AS two, min(CASE WHEN side <> 'full' THEN y0 END) OVER w AS top FROM s WINDOW w AS (PARTITION BY page_id))
SELECT page_id, element_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN NOT two THEN 0 WHEN side = 'full' AND y0 <= top THEN 0 WHEN side = 'left' THEN 1 WHEN side = 'right' THEN 2 ELSE 3 END, y0, x0, element_id) AS reading_order FROM p""")
def reading_order(spark, sf_dir):
    return sequences.reading_order(observations(spark, sf_dir), "page_id", F.lit(160.0)).select("page_id", "element_id", "reading_order")


@query(f"""WITH {OBS_SQL}, a AS (SELECT page_id, element_id AS r, row_number() OVER (PARTITION BY page_id ORDER BY y0, x1, element_id) AS c FROM obs),
m AS (SELECT x.page_id, count(*) FILTER (x.c < y.c) / count(*) AS s FROM a x JOIN a y ON x.page_id = y.page_id AND x.r < y.r GROUP BY 1)
SELECT page_id, round(coalesce(s, 1), 9) AS order_accuracy FROM (SELECT DISTINCT page_id FROM a) LEFT JOIN m USING (page_id)""")
def order_concordance(spark, sf_dir):
    from pyspark.sql import Window

    rows = observations(spark, sf_dir).withColumn("c", F.row_number().over(Window.partitionBy("page_id").orderBy("y0", "x1", "element_id")))
    return sequences.concordance(rows, "page_id", "element_id", "c").withColumn("order_accuracy", F.round("order_accuracy", 9))


@query(f"""WITH {LINES_SQL}, e AS (SELECT o_custkey AS doc, l_orderkey AS page, l_linenumber AS element_id, l_linestatus || '  ' || (l_partkey % 2) AS text, (l_linenumber - 1) / 6 AS y FROM lines JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, CASE WHEN y <= 0.1 THEN 'header' WHEN y >= 0.9 THEN 'footer' END AS role FROM e),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM k GROUP BY 1), s AS (SELECT doc, key, role, count(DISTINCT page) AS n FROM k WHERE role IS NOT NULL GROUP BY 1, 2, 3)
SELECT k.doc, k.page, k.element_id, k.role FROM k JOIN s USING (doc, key, role) JOIN p USING (doc) WHERE pages >= 2 AND n >= greatest(2, ceil(pages / 2))""")
def boundary_roles(spark, sf_dir):
    at = lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = at.select(F.col("o_custkey").alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("element_id"), F.concat("l_linestatus", F.lit("  "), (F.col("l_partkey") % 2).cast("string")).alias("text"), ((F.col("l_linenumber") - 1) / 6).alias("y"))
    return sequences.boundary_roles(rows, "doc", "page", F.col("y")).select("doc", "page", "element_id", "role")


@query(f"""WITH {OBS_SQL}, b AS (SELECT *, max(x1) OVER (PARTITION BY page_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM obs),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR x0 - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT page_id, run::BIGINT AS run, min(x0) AS run_start, max(x1) AS run_end, count(*) AS n FROM r GROUP BY 1, 2""")
def merged_runs(spark, sf_dir):
    return sequences.merged_runs(observations(spark, sf_dir), ["page_id"], "x0", "x1", 2.0)


@query(f"""WITH {OBS_SQL}, l AS (SELECT *, lag(y0) OVER w AS t, lag(y1) OVER w AS u FROM obs WINDOW w AS (PARTITION BY page_id ORDER BY y0, x0, element_id))
SELECT page_id, element_id, (sum(CASE WHEN least(y1, u) - greatest(y0, t) >= 0.55 * least(y1 - y0, u - t) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY y0, x0, element_id ROWS UNBOUNDED PRECEDING))::BIGINT AS line FROM l""")
def flow_lines(spark, sf_dir):
    return sequences.flow_lines(observations(spark, sf_dir), "page_id").select("page_id", "element_id", "line")


@query(f"""WITH {OBS_SQL}, g AS (SELECT * FROM (SELECT page_id, lead(y0) OVER (PARTITION BY page_id ORDER BY y0) - y0 AS gap FROM obs) WHERE gap > 0), c AS (SELECT page_id, gap, count(*) AS c FROM g GROUP BY 1, 2),
n AS (SELECT a.page_id, a.gap, sum(b.c) AS near FROM c a JOIN c b ON a.page_id = b.page_id AND abs(a.gap - b.gap) <= greatest(a.gap * 0.08, 2.25) GROUP BY 1, 2), t AS (SELECT page_id, sum(c) AS n FROM c GROUP BY 1)
SELECT page_id, gap, near::BIGINT AS near, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY near DESC, gap) AS k FROM n) JOIN t USING (page_id) WHERE k = 1 AND near * 2 > n""")
def dominant_gaps(spark, sf_dir):
    return sequences.dominant_gap(observations(spark, sf_dir), ["page_id"], "y0")


@query(f"""WITH {OBS_SQL}, s AS (SELECT *, CASE WHEN x1 > 80 THEN text END AS label, sum(CASE WHEN kind = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY element_id ROWS UNBOUNDED PRECEDING) AS section FROM obs)
SELECT page_id, element_id, section::BIGINT AS section, last_value(label IGNORE NULLS) OVER (PARTITION BY page_id, section ORDER BY element_id ROWS UNBOUNDED PRECEDING) AS group_label FROM s""")
def carried_labels(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("label", F.when(F.col("x1") > 80, F.col("text")))
    return sequences.carried_label(rows, ["page_id"], "element_id", "label", F.col("kind") == "title").select("page_id", "element_id", "section", "group_label")


@query("""WITH s AS (SELECT conv_id, a.turn AS first, n AS size, (SELECT string_agg(role, ' ' ORDER BY turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn >= a.turn AND b.turn < a.turn + n) AS span_text,
  (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn >= a.turn AND b.turn < a.turn + n) AS c FROM conversations a, (SELECT unnest(range(1, 4)) AS n)) SELECT conv_id, first, size::INTEGER AS size, span_text FROM s WHERE c = size""")
def text_spans(spark, sf_dir):
    return sequences.spans(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", 3)


def _text_lines(d, of, to):
    rows = d.select(F.col(of).alias(to), F.explode(F.split("text", "\n")).alias("line"))
    return rows.select(to, F.lower(F.trim(F.regexp_replace("line", r"\s+", " "))).alias("key")).where("key <> ''")


@query(r"""WITH l AS (SELECT doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS key FROM documents), d AS (SELECT key, count(*) AS n, min(doc_id) AS doc_id FROM l WHERE key <> '' GROUP BY 1),
b AS (SELECT key, count(*) AS n, min(block_id) AS block_id FROM (SELECT item_id AS block_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS key FROM benchmark) WHERE key <> '' GROUP BY 1)
SELECT b.key, b.block_id, d.doc_id FROM b JOIN d USING (key) WHERE b.n = 1 AND d.n = 1""")
def evidence_anchors(spark, sf_dir):
    return sequences.anchors(_text_lines(table(spark, sf_dir, "benchmark"), "item_id", "block_id"), _text_lines(table(spark, sf_dir, "documents"), "doc_id", "doc_id"), "key", "doc_id")


# Metrics


@query("""SELECT p_partkey, round(levenshtein(p_type, p_name) / length(p_type), 9) AS character_error_rate, round(greatest(0, 1 - levenshtein(p_type, p_name) / greatest(length(p_type), length(p_name), 1)), 9) AS character_accuracy, (p_type = p_name)::INT::DOUBLE AS exact_match FROM part""")
def character_metrics(spark, sf_dir):
    out = metrics.text_metrics(table(spark, sf_dir, "part"), "p_type", "p_name")
    return out.select("p_partkey", F.round("character_error_rate", 9).alias("character_error_rate"), F.round("character_accuracy", 9).alias("character_accuracy"), "exact_match")


@query()
def text_metrics(spark, sf_dir):
    """Benchmark passages against all documents whose whole lines they share; the distances have no SQL form. A line or a
    passage may be in very many documents, so both joins with benchmark are salted by the document."""
    salts = 32
    salt = F.pmod(F.hash("doc_id"), F.lit(salts)).alias("salt")
    salted = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    benchmark, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    shared = _text_lines(docs, "doc_id", "doc_id").distinct().select("*", salt).join(salted(_text_lines(benchmark, "item_id", "item_id").distinct()), ["key", "salt"])
    met = shared.select("item_id", "doc_id").distinct().join(docs.select("doc_id", F.col("text").alias("candidate")), "doc_id").select("*", salt)
    pairs = met.join(salted(benchmark.select("item_id", F.col("text").alias("reference"))), ["item_id", "salt"]).drop("salt")
    out = metrics.text_metrics(pairs)
    return out.select("item_id", "doc_id", *[F.round(c, 9).alias(c) for c in ("character_accuracy", "word_accuracy", "numerical_accuracy", "text_score")])


@query()
def document_numbers(spark, sf_dir):
    """Numbers of all texts. SQL has no look-behind, so they are held against a regular expression of another engine in the
    tests."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t.numbers(F.coalesce("text", F.lit("")))).cast("long").alias("n_numbers"))


@query(f"""WITH {OBS_SQL}, r AS (SELECT page_id, kind, count(*) AS r FROM obs WHERE source = 'src0' GROUP BY 1, 2), c AS (SELECT page_id, kind, count(*) AS c FROM obs WHERE source = 'src1' GROUP BY 1, 2),
b AS (SELECT page_id, sum(least(coalesce(r, 0), coalesce(c, 0)))::BIGINT AS matched, sum(coalesce(r, 0))::BIGINT AS reference, sum(coalesce(c, 0))::BIGINT AS candidate FROM r FULL JOIN c USING (page_id, kind) GROUP BY 1),
p AS (SELECT *, CASE WHEN candidate > 0 THEN matched / candidate ELSE (reference = 0)::INT END AS p, CASE WHEN reference > 0 THEN matched / reference ELSE (candidate = 0)::INT END AS q FROM b)
SELECT page_id, matched, reference, candidate, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 9) AS type_f1 FROM p""")
def type_f1(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return metrics.type_f1(rows.where("source = 'src0'"), rows.where("source = 'src1'"), ["page_id"]).withColumn("type_f1", F.round("type_f1", 9))


@query(f"""WITH {OBS_SQL}, m AS (SELECT a.page_id, a.x0 AS p0, a.y0 AS p1, a.x1 AS p2, a.y1 AS p3, b.x0 AS q0, b.y0 AS q1, b.x1 AS q2, b.y1 AS q3 FROM obs a JOIN obs b ON a.page_id = b.page_id AND b.element_id = a.element_id + 2 AND a.element_id % 2 = 1),
s AS (SELECT page_id, CASE WHEN least(p2, q2) > greatest(p0, q0) AND least(p3, q3) > greatest(p1, q1) THEN (least(p2, q2) - greatest(p0, q0)) * (least(p3, q3) - greatest(p1, q1)) ELSE 0 END AS o, (p2 - p0) * (p3 - p1) + (q2 - q0) * (q3 - q1) AS a,
  greatest(0, 1 - sqrt(((p0 + p2 - q0 - q2) / 2) ** 2 + ((p1 + p3 - q1 - q3) / 2) ** 2) / sqrt(160.0 ** 2 + 200.0 ** 2)) AS pos, (least(p2 - p0, q2 - q0) / greatest(p2 - p0, q2 - q0) + least(p3 - p1, q3 - q1) / greatest(p3 - p1, q3 - q1)) / 2 AS sz FROM m),
n AS (SELECT page_id, count(*) AS matched, avg(o / (a - o)) AS i, avg(pos) AS p, avg(sz) AS z FROM s GROUP BY 1), c AS (SELECT page_id, count(*) FILTER (element_id % 2 = 1) AS reference, count(*) FILTER (element_id % 2 = 1 AND element_id > 1) AS candidate FROM obs GROUP BY 1),
f AS (SELECT page_id, coalesce(matched, 0) AS matched, coalesce(i, e) AS i, coalesce(p, e) AS p, coalesce(z, e) AS z, CASE WHEN candidate > 0 THEN coalesce(matched, 0) / candidate ELSE (reference = 0)::INT END AS pr, CASE WHEN reference > 0 THEN coalesce(matched, 0) / reference ELSE (candidate = 0)::INT END AS re
  FROM (SELECT *, CASE WHEN reference = 0 AND candidate = 0 THEN 1.0 ELSE 0.0 END AS e FROM c LEFT JOIN n USING (page_id)))
SELECT page_id, matched, round(0.45 * i + 0.20 * p + 0.15 * z + 0.10 + 0.10 * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS layout_score FROM f""")
def layout_score(spark, sf_dir):
    rows = observations(spark, sf_dir)
    right = rows.select("page_id", (F.col("element_id") - 2).alias("element_id"), *[F.col(c).alias(f"{c}2") for c in ("x0", "y0", "x1", "y1")])
    pairs = rows.where("element_id % 2 = 1").join(right, ["page_id", "element_id"])
    counts = rows.groupBy("page_id").agg(F.count_if(F.col("element_id") % 2 == 1).alias("reference"), F.count_if((F.col("element_id") % 2 == 1) & (F.col("element_id") > 1)).alias("candidate"))
    return metrics.layout_metrics(pairs, counts, ["page_id"], F.lit(160.0), F.lit(200.0)).select("page_id", F.col("matched").cast("long").alias("matched"), F.round("layout_score", 6).alias("layout_score"))


@query(f"""WITH {LINES_SQL}, c AS (SELECT l_orderkey AS table_id, (l_linenumber - 1) // 2 AS "row", (l_linenumber - 1) % 2 AS "column", 1 + l_suppkey % 2 AS row_span, 1 + l_partkey % 2 AS column_span, l_linestatus || (l_partkey % 3) AS text, l_suppkey FROM lines),
a AS (SELECT * FROM c WHERE l_suppkey % 5 <> 0), b AS (SELECT table_id, "row", "column", 3 - row_span AS row_span2, column_span AS column_span2, substr(text, 1, 1) || '0' AS text2 FROM c WHERE l_suppkey % 7 <> 0),
j AS (SELECT coalesce(a.table_id, b.table_id) AS table_id, CASE WHEN text IS NOT NULL AND text2 IS NOT NULL THEN 1 - levenshtein(text, text2) / 2 ELSE 0 END AS t,
  CASE WHEN text IS NOT NULL AND text2 IS NOT NULL THEN (least(row_span, row_span2) / greatest(row_span, row_span2) + least(column_span, column_span2) / greatest(column_span, column_span2)) / 2 ELSE 0 END AS s FROM a FULL JOIN b ON a.table_id = b.table_id AND a."row" = b."row" AND a."column" = b."column"),
m AS (SELECT table_id, avg(t) AS t, avg(s) AS s FROM j GROUP BY 1), x AS (SELECT table_id, max("row" + row_span) AS r, max("column" + column_span) AS k FROM a GROUP BY 1), y AS (SELECT table_id, max("row" + row_span2) AS r2, max("column" + column_span2) AS k2 FROM b GROUP BY 1),
z AS (SELECT m.*, (coalesce(least(coalesce(r, 0), coalesce(r2, 0)) / nullif(greatest(coalesce(r, 0), coalesce(r2, 0)), 0), 1) + coalesce(least(coalesce(k, 0), coalesce(k2, 0)) / nullif(greatest(coalesce(k, 0), coalesce(k2, 0)), 0), 1)) / 2 AS p FROM m LEFT JOIN x USING (table_id) LEFT JOIN y USING (table_id))
SELECT table_id, round(p, 8) AS topology, round(t, 8) AS cell_text, round(s, 8) AS span, round(0.35 * p + 0.40 * t + 0.25 * s, 8) AS table_accuracy FROM z""")
def table_accuracy(spark, sf_dir):
    at = lines(spark, sf_dir)
    cells = at.select(F.col("l_orderkey").alias("table_id"), F.floor((F.col("l_linenumber") - 1) / 2).alias("row"), ((F.col("l_linenumber") - 1) % 2).alias("column"), (1 + F.col("l_suppkey") % 2).alias("row_span"), (1 + F.col("l_partkey") % 2).alias("column_span"), F.concat("l_linestatus", (F.col("l_partkey") % 3).cast("string")).alias("text"), "l_suppkey")
    other = cells.where("l_suppkey % 7 <> 0").withColumns({"row_span": 3 - F.col("row_span"), "text": F.concat(F.substring("text", 1, 1), F.lit("0"))})
    out = metrics.table_accuracy(cells.where("l_suppkey % 5 <> 0"), other, ["table_id"])
    return out.select("table_id", *[F.round(c, 8).alias(c) for c in ("topology", "cell_text", "span", "table_accuracy")])


@query(f"""WITH {OBS_SQL}, e AS (SELECT page_id, CASE WHEN element_id % 4 = 0 THEN 'table' WHEN element_id % 4 = 1 THEN 'image' ELSE 'paragraph' END AS kind, CASE WHEN x0::INT % 3 = 0 THEN '' ELSE text END AS text, CASE WHEN y1::INT % 5 = 0 THEN true END AS stated, x1::INT % 6 = 0 AS flat, y0::INT % 2 = 0 AS whole FROM obs),
c AS (SELECT *, coalesce(stated AND (kind = 'table' OR trim(text) <> ''), (kind = 'paragraph' AND trim(text) <> '') OR kind = 'table') AND NOT flat AS can FROM e)
SELECT page_id, count(*) AS elements, count(*) FILTER (can) AS editable, count(*) FILTER (flat OR (kind = 'image' AND whole)) AS flattened, round(count(*) FILTER (can) / count(*), 9) AS editable_ratio, round(count(*) FILTER (can AND kind = 'paragraph') / count(*), 9) AS native_text_ratio, round(count(*) FILTER (can AND kind = 'table') / count(*), 9) AS native_structure_ratio FROM c GROUP BY 1""")
def editability(spark, sf_dir):
    e = F.col("element_id") % 4
    whole = lambda c: F.round(c).cast("int")
    rows = observations(spark, sf_dir).select(
        "page_id", F.when(e == 0, "table").when(e == 1, "image").otherwise("paragraph").alias("kind"), F.when(whole("x0") % 3 == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(whole("y1") % 5 == 0, F.lit(True)).alias("stated"), (whole("x1") % 6 == 0).alias("flattened"), (whole("y0") % 2 == 0).alias("full_page"),
    )
    out = metrics.editability(rows, ["page_id"])
    return out.select("page_id", "elements", "editable", "flattened", *[F.round(c, 9).alias(c) for c in ("editable_ratio", "native_text_ratio", "native_structure_ratio")])


FIDELITY_SQL = """WITH c AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (event_id % 101) / 101 END AS text, CASE WHEN event_id % 4 <> 0 THEN (event_id % 97) / 97 END AS layout, CASE WHEN event_id % 5 <> 0 THEN (event_id % 89) / 89 END AS structure, CASE WHEN event_id % 12 <> 0 THEN 0.5 END AS editability, NULL::DOUBLE AS visual FROM events),
s AS (SELECT event_id, coalesce(text * 0.28, 0) + coalesce(layout * 0.18, 0) + coalesce(structure * 0.20, 0) + coalesce(editability * 0.16, 0) AS s, CASE WHEN text IS NULL THEN 0 ELSE 0.28 END + CASE WHEN layout IS NULL THEN 0 ELSE 0.18 END + CASE WHEN structure IS NULL THEN 0 ELSE 0.20 END + CASE WHEN editability IS NULL THEN 0 ELSE 0.16 END AS w FROM c)
SELECT event_id, round(CASE WHEN w > 0 THEN s / w ELSE 0 END, 6)::DOUBLE AS overall_measured, round(s, 6)::DOUBLE AS overall_strict, round(w, 6)::DOUBLE AS measurement_coverage FROM s"""


@query(FIDELITY_SQL)
def fidelity_scores(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, F.when(e % 3 != 0, (e % 101) / 101).alias("text"), F.when(e % 4 != 0, (e % 97) / 97).alias("layout"), F.when(e % 5 != 0, (e % 89) / 89).alias("structure"), F.when(e % 12 != 0, 0.5).alias("editability"), F.lit(None).cast("double").alias("visual"))
    out = metrics.fidelity(rows, metrics.profile("balanced"))
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("overall_measured", "overall_strict", "measurement_coverage")])


# Benchmarks


@query(f"WITH {RUNS_SQL} SELECT system, count(*) AS cases, count(*) FILTER (score IS NULL) AS failed, round(avg(coalesce(score, 0)), 9) AS mean_score, CASE WHEN count(*) FILTER (score IS NULL) = 0 THEN round(avg(seconds), 6) END AS mean_seconds FROM runs GROUP BY 1")
def benchmark_means(spark, sf_dir):
    out = benchmarks.mean_scores(runs(spark, sf_dir), ["system"], ["seconds"])
    return out.withColumns({"mean_score": F.round("mean_score", 9), "mean_seconds": F.round("mean_seconds", 6)})


@query(f"""WITH {RUNS_SQL}, s AS (SELECT score, 'kind' AS dimension, unnest([event_type, 'all']) AS value FROM runs UNION ALL SELECT score, 'system', system FROM runs)
SELECT dimension, value, count(*) AS cases, count(score) AS scored, round(avg(score), 9) AS mean_score FROM s GROUP BY 1, 2""")
def benchmark_slices(spark, sf_dir):
    rows = benchmarks.slices(runs(spark, sf_dir), {"kind": F.array("event_type", F.lit("all")), "system": F.array("system")})
    return benchmarks.scored_means(rows, ["dimension", "value"]).withColumn("mean_score", F.round("mean_score", 9))


@query(f"""WITH {RUNS_SQL}, q AS (SELECT (case_id // 7) % 300 AS grp, complete, CASE WHEN case_id % 50 = 0 THEN 'draft' ELSE 'full' END AS profile, coalesce(score, 0) AS quality, score > 0.5 AS accepted, status = 'success' AS succeeded FROM runs)
SELECT grp, count(*) AS cases, count(*) FILTER (complete) AS complete_cases, count(*) FILTER (accepted) AS accepted_cases, CASE WHEN bool_and(complete) AND count(DISTINCT CASE WHEN complete THEN profile END) = 1 THEN round(sum(quality) / count(*), 9) END AS mean_quality, round(count(*) FILTER (succeeded) / count(*), 9) AS success_rate FROM q GROUP BY 1""")
def comparable_quality(spark, sf_dir):
    rows = runs(spark, sf_dir).select((F.floor(F.col("case_id") / 7) % 300).alias("grp"), "complete", F.when(F.col("case_id") % 50 == 0, "draft").otherwise("full").alias("profile"), F.coalesce("score", F.lit(0.0)).alias("quality"), (F.col("score") > 0.5).alias("accepted"), (F.col("status") == "success").alias("succeeded"))
    out = benchmarks.comparable_quality(rows, ["grp"])
    return out.withColumns({"mean_quality": F.round("mean_quality", 9), "success_rate": F.round("success_rate", 9)})


@query(f"WITH {RUNS_SQL} SELECT event_type, count(seconds) AS n, round(sum(seconds), 4) AS total, round(avg(seconds), 6) AS mean, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95, max(seconds) AS maximum FROM runs GROUP BY 1")
def phase_statistics(spark, sf_dir):
    out = benchmarks.phase_statistics(runs(spark, sf_dir), ["event_type"], "seconds")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query(f"""WITH {RUNS_SQL} SELECT system, count(*) AS cases, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'crash') AS n_crash, round(count(*) FILTER (status = 'success') / count(*), 9) AS success_rate, round(avg(seconds), 6) AS mean_seconds,
round(avg(seconds) FILTER (status = 'success'), 6) AS mean_seconds_ok, round(quantile_cont(seconds, 0.5) FILTER (status = 'success'), 6) AS p50_seconds_ok, round(quantile_cont(seconds, 0.95) FILTER (status = 'success'), 6) AS p95_seconds_ok FROM runs GROUP BY 1""")
def system_summary(spark, sf_dir):
    out = benchmarks.system_summary(runs(spark, sf_dir), ["system"], ["success", "crash"])
    return out.withColumns({"success_rate": F.round("success_rate", 9), **{c: F.round(c, 6) for c in ("mean_seconds", "mean_seconds_ok", "p50_seconds_ok", "p95_seconds_ok")}})


@query(f"""WITH {OBS_SQL}, g AS (SELECT page_id, unnest([coalesce(x1 > x0, false), coalesce(confidence >= 0.95, false), coalesce(x1 <= 150, false)]) AS passed FROM obs)
SELECT page_id, count(*) AS gates, round(avg(passed::INT), 9) AS gate_score, bool_and(passed) AS accepted FROM g GROUP BY 1""")
def validation_gates(spark, sf_dir):
    long = benchmarks.gates(observations(spark, sf_dir), ["page_id"], {"ordered_box": F.col("x1") > F.col("x0"), "sure": F.col("confidence") >= 0.95, "inside": F.col("x1") <= 150})
    return benchmarks.gate_scores(long, ["page_id"]).withColumn("gate_score", F.round("gate_score", 9))


@query(f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN (l_tax, l_discount, l_quantity) < (0.04, 0.05, 25.0) THEN -1 WHEN (l_tax, l_discount, l_quantity) > (0.04, 0.05, 25.0) THEN 1 ELSE 0 END AS verdict FROM lines")
def objective_comparison(spark, sf_dir):
    verdict = benchmarks.better([F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")], [F.lit(0.04), F.lit(0.05), F.lit(25.0)])
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


# Routing


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\b(invoice|invoice number|amount due|bill to)\b') THEN 'invoice' WHEN regexp_matches(lower(text), '\b(balance sheet|cash flows?|income statement|total assets)\b') THEN 'financial-statement'
WHEN regexp_matches(lower(text), '\b(abstract|methodology|references|doi:)\b') THEN 'academic-paper' WHEN n_chars // 3000 >= 20 THEN 'book' ELSE 'report' END AS archetype FROM documents""")
def document_archetypes(spark, sf_dir):
    kind = routing.archetype(F.col("text"), F.lit(0.0), F.lit(0.0), F.floor(F.col("n_chars") / 3000), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("archetype"))


ROUTE_SQL = f"""WITH {OBS_SQL}, e AS (SELECT page_id, element_id, CASE WHEN element_id % 4 = 0 THEN 'table' WHEN kind = 'title' THEN 'image' ELSE 'text' END AS kind, confidence, CASE WHEN source = 'src0' THEN 'paddleocr' ELSE 'mineru' END AS existing, x0::INT % 3 = 0 AS split FROM obs),
r AS (SELECT *, coalesce(confidence < 0.95, false) AS low FROM e WHERE kind <> 'image'), k AS (SELECT *, existing = 'paddleocr' AND (low OR split) AS turn FROM r WHERE low OR split OR kind = 'table')
SELECT page_id, element_id, CASE WHEN NOT turn THEN 'paddleocr' WHEN kind = 'table' THEN 'mineru' ELSE 'olmocr' END AS "primary", CASE WHEN split THEN 'adjudicate' WHEN low THEN 'retry' ELSE 'extract' END AS action, CASE WHEN low OR split THEN 6.0 ELSE 1.0 END::DOUBLE AS cost FROM k"""


@query(ROUTE_SQL)
def routing_tasks(spark, sf_dir):
    rows = observations(spark, sf_dir).select(
        "page_id", "element_id", F.when(F.col("element_id") % 4 == 0, "table").when(F.col("kind") == "title", "image").otherwise("text").alias("kind"), "confidence", F.when(F.col("source") == "src0", "paddleocr").otherwise("mineru").alias("existing"),
        F.when(F.col("x0").cast("int") % 3 == 0, F.array(F.lit("A  b"), F.lit("c"))).otherwise(F.array(F.lit("A  b"), F.lit("a b "))).alias("readings"), F.lit(False).alias("handwritten"), F.lit(False).alias("complex_layout"),
    )
    return routing.route(rows, 0.95).select("page_id", "element_id", "primary", "action", "cost")


@query("""WITH p AS (SELECT 'p' || s_suppkey AS provider, (s_suppkey % 3)::INT AS privacy, (s_suppkey % 5)::INT AS cost, s_suppkey % 2 = 0 AS creds, s_nationkey % 2 = 0 AS tables, s_nationkey % 3 = 0 AS math, CASE WHEN s_suppkey % 4 = 0 THEN ['local'] ELSE ['local', 'cloud'] END AS modes FROM supplier),
r AS (SELECT n_nationkey AS request, n_nationkey % 2 = 1 AS w_tables, n_nationkey % 4 = 0 AS w_math, CASE WHEN n_nationkey % 3 = 0 THEN 'cloud' END AS mode FROM nation),
m AS (SELECT request, provider, privacy, cost, creds, mode, (w_tables AND tables)::INT + (w_math AND math)::INT + (mode IS NOT NULL AND list_contains(modes, mode))::INT AS matched, (w_tables AND NOT tables)::INT + (w_math AND NOT math)::INT + (mode IS NOT NULL AND NOT list_contains(modes, mode))::INT AS missing FROM r, p),
s AS (SELECT *, CASE WHEN missing = 0 THEN 1000 + 20 * matched + CASE WHEN mode IS NOT NULL THEN 30 ELSE 0 END + 4 * privacy + greatest(0, 4 - cost) + CASE WHEN creds THEN 0 ELSE 2 END ELSE -missing END AS score FROM m)
SELECT request, row_number() OVER (PARTITION BY request ORDER BY missing > 0, score DESC, provider)::INT AS rank, provider, missing = 0 AS compatible, score, matched, missing FROM s""")
def provider_ranking(spark, sf_dir):
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    providers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("p"), s.cast("string")).alias("provider"), (s % 3).cast("int").alias("privacy"), (s % 5).cast("int").alias("cost"), (s % 2 == 0).alias("needs_credentials"), (F.col("s_nationkey") % 2 == 0).alias("tables"), (F.col("s_nationkey") % 3 == 0).alias("math"),
        F.when(s % 4 == 0, F.array(F.lit("local"))).otherwise(F.array(F.lit("local"), F.lit("cloud"))).alias("modes"),
    )
    requests = table(spark, sf_dir, "nation").select(n.alias("request"), F.when(n % 3 == 0, "cloud").alias("mode"), (n % 2 == 1).alias("tables"), (n % 4 == 0).alias("math"))
    return routing.rank_providers(requests, providers, ["tables", "math"])


@query(f"""WITH {LINES_SQL}, t AS (SELECT l_orderkey AS block, l_partkey % 4 AS candidate_id, round(l_quantity / 50, 2) AS total, l_discount AS text_score, l_tax AS geometry_score, l_extendedprice AS type_score, l_linenumber AS page FROM lines),
d AS (SELECT *, row_number() OVER (PARTITION BY block, candidate_id ORDER BY total DESC, text_score DESC, geometry_score DESC, type_score DESC, page) AS n FROM t)
SELECT * FROM (SELECT block, candidate_id, total, page, row_number() OVER (PARTITION BY block ORDER BY total DESC, text_score DESC, geometry_score DESC, type_score DESC, page, candidate_id)::INT AS rank FROM d WHERE n = 1) WHERE rank <= 2""")
def top_traces(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("block"), (F.col("l_partkey") % 4).alias("candidate_id"), F.round(F.col("l_quantity") / 50, 2).alias("total"), F.col("l_discount").alias("text_score"), F.col("l_tax").alias("geometry_score"), F.col("l_extendedprice").alias("type_score"), F.col("l_linenumber").alias("page"))
    return routing.top_traces(rows, ["block"], 2).select("block", "candidate_id", "total", "page", "rank")


@query(f"""WITH {LINES_SQL} SELECT l_orderkey, (list(l_suppkey ORDER BY l_linenumber) FILTER (l_returnflag = 'A'))[1] AS provider, coalesce(min(l_linenumber) FILTER (l_returnflag = 'A'), count(*))::BIGINT AS tries FROM lines GROUP BY 1""")
def first_success(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("provider"), (F.col("l_returnflag") == "A").alias("ok"))
    return routing.first_success(rows, ["l_orderkey"]).withColumn("tries", F.col("tries").cast("long"))


# Graphs


@query(f"""WITH {OBS_SQL} SELECT a.page_id, a.element_id AS src, b.element_id AS dst, round(greatest(0.6, least(0.95, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0))), 9) AS confidence
FROM obs a JOIN obs b ON a.page_id = b.page_id AND a.y1 <= b.y0 AND a.element_id <> b.element_id WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) >= 0.2""")
def vertical_edges(spark, sf_dir):
    rows = observations(spark, sf_dir).select("page_id", F.col("element_id").alias("region_id"), "x0", "y0", "x1", "y1")
    return graphs.vertical_edges(rows, "page_id").withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH RECURSIVE {OBS_SQL}, e AS (SELECT a.page_id, a.element_id AS src, b.element_id AS dst FROM obs a JOIN obs b ON a.page_id = b.page_id AND a.y1 <= b.y0 AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) >= 0.2),
n AS (SELECT page_id, src AS node, 0::BIGINT AS layer FROM e UNION SELECT e.page_id, e.dst, n.layer + 1 FROM n JOIN e ON n.page_id = e.page_id AND n.node = e.src)
SELECT page_id, node, max(layer) AS layer FROM n GROUP BY 1, 2""")
def topological_layers(spark, sf_dir):
    rows = observations(spark, sf_dir).select("page_id", F.col("element_id").alias("region_id"), "x0", "y0", "x1", "y1")
    return graphs.topological_layers(graphs.vertical_edges(rows, "page_id"), "page_id")


@query(f"""WITH {LINES_SQL}, r AS (SELECT l_orderkey AS page, l_linenumber AS element_id FROM lines WHERE l_suppkey % 11 <> 0 UNION ALL SELECT l_orderkey, l_linenumber FROM lines WHERE l_suppkey % 13 = 0), h AS (SELECT page, element_id, count(*) AS n FROM r GROUP BY 1, 2),
j AS (SELECT coalesce(l_orderkey, page) AS page, l_linenumber, n FROM lines FULL JOIN h ON l_orderkey = page AND l_linenumber = element_id)
SELECT page, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (l_linenumber IS NULL) AS unknown, count(*) FILTER (n > 1) AS repeated FROM j GROUP BY 1 HAVING count(*) FILTER (n IS NULL) + count(*) FILTER (l_linenumber IS NULL) + count(*) FILTER (n > 1) > 0""")
def partition_faults(spark, sf_dir):
    at = lines(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("element_id"), "l_suppkey")
    regions = at.where("l_suppkey % 11 <> 0").union(at.where("l_suppkey % 13 = 0"))
    return graphs.partition_faults(regions, at, "page")


# Scalars, markup and sources


@query("SELECT c_custkey, regexp_replace(regexp_replace(c_name || ' / ' || c_mktsegment || '.', '[^A-Za-z0-9_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS slug FROM customer")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", t.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("."))).alias("slug"))


@query(f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END AS share, CASE WHEN l_extendedprice > 1 AND l_extendedprice <= 100 THEN l_extendedprice / 100 ELSE least(l_extendedprice, 1.0) END AS held FROM lines")
def coerced_confidences(spark, sf_dir):
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", t.coerced_confidence(F.col("l_quantity")).alias("share"), t.coerced_confidence(F.col("l_extendedprice")).alias("held"))


TYPES_SQL = "SELECT page_id, tag, n, CASE " + " ".join(f"WHEN contains(v, '{a}') THEN '{b}'" for a, b in t.TYPE_RULES) + " ELSE 'text' END AS kind FROM (SELECT page_id, tag, count(*) AS n, replace(replace(lower(tag || ' list-item'), '-', '_'), ' ', '_') AS v FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) GROUP BY 1, 2)"


@query(TYPES_SQL)
def element_types(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", t.element_type(F.concat("tag", F.lit(" list-item"))))


@query("SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) AS key FROM documents")
def normalized_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.normalized(F.col("text")), 256).alias("key"))


KINDS_SQL = r"""WITH l AS (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS t FROM documents) SELECT CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^(```|~~~)') THEN 'fence' WHEN regexp_matches(t, '^#{1,6}\s+\S') THEN 'heading'
WHEN regexp_matches(t, '^(-(\s*-){2,}|\*(\s*\*){2,}|_(\s*_){2,})$') THEN 'rule' WHEN regexp_matches(t, '^([-*+]|\d{1,9}[.)])\s+\S') THEN 'list_item' WHEN starts_with(t, '>') THEN 'quote' WHEN regexp_matches(t, '^\|.*\|$') THEN 'table_row' WHEN regexp_matches(t, '^!\[[^\]]*\]\([^)]*\)$') THEN 'image' ELSE 'paragraph' END AS kind, count(*) AS n FROM l GROUP BY 1"""


@query(KINDS_SQL)
def line_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return rows.select(t.line_kind(F.col("line")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


VISIBLE_SQL = r"""WITH v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->', '', 'g'), '(?i)</?(p|div|section|h[1-6]|tr|br)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS v FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(v, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS v FROM v)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS visible FROM e"""


@query(VISIBLE_SQL)
def visible_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.visible_html(F.col("html")).alias("visible"))


@query(r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)\s*>')) AS b, generate_subscripts(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)\s*>'), 1) - 1 AS ordinal FROM pages)
SELECT page_id, ordinal::INT AS ordinal, lower(regexp_extract(b, '^<([a-zA-Z0-9]+)', 1)) AS tag, trim(regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM b""")
def html_blocks(spark, sf_dir):
    return markup.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def markdown_blocks(spark, sf_dir):
    return markup.parse_markdown(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'aws_textract' WHEN event_id % 4 = 1 THEN 'olmocr' WHEN event_id % 4 = 2 THEN 'paddleocr' END AS provider, CASE WHEN event_id % 4 = 0 THEN 0.99 WHEN event_id % 4 = 1 THEN 0.97 WHEN event_id % 4 = 2 THEN 0.94 ELSE 0 END::DOUBLE AS confidence, false AS ambiguous FROM events")
def detected_schemas(spark, sf_dir):
    e = F.col("event_id") % 4
    body = F.when(e == 0, F.lit('{"Blocks":[{"BlockType":"LINE","props":')).when(e == 1, F.lit('{"natural_text":"x","props":')).when(e == 2, F.lit('{"ocr_results":[],"props":')).otherwise(F.lit('{"props":'))
    tail = F.when(e == 0, F.lit("}]}")).otherwise(F.lit("}"))
    return sniff.detect(table(spark, sf_dir, "events").select("event_id", F.concat(body, "props", tail).alias("payload"))).select("event_id", "provider", "confidence", "ambiguous")


@query(f"""WITH {LINES_SQL}, w AS (SELECT l_orderkey AS page_num, l_linenumber // 3 AS line_num, l_linenumber AS word_num, l_partkey % 500 AS l, l_suppkey % 300 AS t, l_quantity::BIGINT AS w, 20 AS h, CASE WHEN l_tax > 0.02 THEN 100 * (1 - l_discount) ELSE -1 END AS conf, CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_linestatus || l_linenumber END AS text FROM lines)
SELECT page_num, line_num, string_agg(trim(text), ' ' ORDER BY word_num) AS text, min(l) AS x0, min(t) AS y0, max(l + w) AS x1, max(t + h) AS y1, round(avg(conf) FILTER (conf >= 0) / 100, 9) AS confidence FROM w WHERE trim(text) <> '' AND w > 0 GROUP BY 1, 2""")
def word_lines(spark, sf_dir):
    at = lines(spark, sf_dir)
    words = at.select(
        F.lit(5).alias("level"), F.col("l_orderkey").alias("page_num"), F.floor(F.col("l_linenumber") / 3).cast("int").alias("line_num"), F.col("l_linenumber").alias("word_num"), (F.col("l_partkey") % 500).alias("left"), (F.col("l_suppkey") % 300).alias("top"), F.col("l_quantity").cast("long").alias("width"), F.lit(20).alias("height"),
        F.when(F.col("l_tax") > 0.02, 100 * (1 - F.col("l_discount"))).otherwise(-1.0).alias("conf"), F.when(F.col("l_returnflag") == "R", " ").otherwise(F.concat("l_linestatus", F.col("l_linenumber").cast("string"))).alias("text"),
    )
    return sniff.word_lines(words, ["page_num", "line_num"]).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH {OBS_SQL}, m AS (SELECT page_id, element_id, CASE kind WHEN 'title' THEN '# ' || text WHEN 'unknown' THEN '- ' || text ELSE text END AS line FROM obs)
SELECT page_id // 12 AS doc, string_agg(page, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_id) AS markdown FROM (SELECT page_id, string_agg(line, chr(10) || chr(10) ORDER BY element_id) AS page FROM m GROUP BY 1) GROUP BY 1""")
def rendered_markdown(spark, sf_dir):
    rows = observations(spark, sf_dir).select(F.floor(F.col("page_id") / 12).alias("doc"), "page_id", F.col("element_id").alias("reading_order"), F.when(F.col("kind") == "unknown", "list_item").otherwise(F.col("kind")).alias("kind"), "text", F.lit(None).cast("int").alias("level"))
    return sinks.markdown(rows, "doc", "page_id")


@query(f"WITH {OBS_SQL} SELECT page_id, element_id, y0 AS x0, 160 - x1 AS y0, y1 AS x1, 160 - x0 AS y1 FROM obs")
def rotated_boxes(spark, sf_dir):
    turned = g.rotate(g.box(), F.lit(270), F.lit(160.0), F.lit(200.0))
    return observations(spark, sf_dir).select("page_id", "element_id", *[c.alias(n) for c, n in zip(turned, ("x0", "y0", "x1", "y1"), strict=True)])


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
