"""Pieces of saved results: boxes, texts, sizes, hints, sidecars, images and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import LINES_SQL, OBS_SQL, lines, observations, table
from ..functions import ids
from ..functions import text as t
from ..operators import governance  # noqa: F401
from ..registry import query
from ..sources import payloads


def _shown(c):
    """Numbers as whole text, the same in both engines."""
    return c.cast("long").cast("string")


@query(f"""WITH {OBS_SQL} SELECT page_id, element_id, CASE WHEN element_id % 8 <> 7 THEN x0 END AS x0, CASE WHEN element_id % 8 <> 7 THEN y0 END AS y0, CASE WHEN element_id % 8 <> 7 THEN x1 END AS x1, CASE WHEN element_id % 8 <> 7 THEN y1 END AS y1 FROM obs""")
def coerced_boxes(spark, sf_dir):
    """The same boxes, stated in seven ways (and not at all)."""
    rows = observations(spark, sf_dir)
    x0, y0, x1, y1 = (_shown(F.col(c)) for c in ("x0", "y0", "x1", "y1"))
    said = lambda pattern, *c: F.format_string(pattern, *c)
    ways = [
        said('{"x0":%s,"y0":%s,"x1":%s,"y1":%s}', x1, y0, x0, y1), said('{"left":%s,"top":"%s","right":%s,"bottom":%s}', x0, y0, x1, y1),
        said('{"x":%s,"y":%s,"width":%s,"height":%s}', x0, y0, _shown(F.col("x1") - F.col("x0")), _shown(F.col("y1") - F.col("y0"))), said('{"bbox":[%s,%s,%s,%s]}', x1, y1, x0, y0),
        said("[%s,%s,%s,%s]", x0, y0, x1, y1), said('{"polygon":[[%s,%s],[%s,%s],[%s,%s]]}', x0, y0, x1, y0, x1, y1), said('{"poly":[%s,%s,%s,%s,%s,%s,%s,%s]}', x0, y1, x1, y1, x1, y0, x0, y0), F.lit('{"bbox":"none","text":"x"}'),
    ]
    stated = F
    for k, way in enumerate(ways):  # a choice of one: an array would have all of them worked out
        stated = stated.when(F.col("element_id") % 8 == k, way)
    box = payloads.coerced_box(stated)
    return rows.select("page_id", "element_id", box.alias("b")).select("page_id", "element_id", "b.*")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '' ELSE role END AS piece FROM conversations), k AS (SELECT *, lag(piece) OVER (PARTITION BY conv_id ORDER BY turn, piece) AS before FROM c WHERE piece <> '')
SELECT conv_id, string_agg(piece, chr(10) ORDER BY turn, piece) AS joined FROM k WHERE before IS NULL OR before <> piece GROUP BY 1""")
def joined_pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("role")).alias("p")).alias("s"))
    pieces = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["p"]).alias("p"))
    return pieces.select("conv_id", payloads.joined_pieces(F.col("p")).alias("joined")).where("joined is not null")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 210.0 WHEN 1 THEN 300.0 WHEN 2 THEN 640.0 WHEN 3 THEN 50.0 WHEN 4 THEN 77.0 ELSE 1.0 END AS width, CASE o_orderkey % 6 WHEN 0 THEN 297.0 WHEN 1 THEN 400.0 WHEN 2 THEN 480.0 WHEN 3 THEN 60.0 WHEN 4 THEN 88.0 ELSE 1.0 END AS height,
CASE o_orderkey % 6 WHEN 0 THEN 7 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE o_orderkey % 4 + 1 END::INTEGER AS page_number FROM orders""")
def page_frames(spark, sf_dir):
    k = F.col("o_orderkey")
    said = ['{"width":210,"page_height":"297","page_num":7}', '{"page_size":{"width":300,"height":400},"number":-2}', '{"img_shape":[480,640,3],"page_idx":4}', '{"width":0,"text":"x"}', "{}", "[]"]
    payload = F.element_at(F.array(*map(F.lit, said)), (k % 6 + 1).cast("int"))
    known = lambda hit, v: F.when(hit, F.lit(v))
    width, height = payloads.page_size(payload, known(k % 6 == 3, 50.0), known(k % 6 == 3, 60.0), known(k % 6 == 4, 77.0), known(k % 6 == 4, 88.0))
    return table(spark, sf_dir, "orders").select(k, width.alias("width"), height.alias("height"), payloads.page_number(payload, k % 4).alias("page_number"))


@query("""WITH d AS (SELECT '/in/' || (p_partkey % 10) || '/f' || p_partkey || '.json' AS path, 'f' || p_partkey || '.json' AS name, CASE WHEN p_size % 4 <> 0 THEN 'olmocr' END AS provider, p_size % 5 = 0 AS ambiguous, p_size % 7 <> 0 AS valid, p_partkey FROM part),
h AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'mineru' WHEN p_partkey % 5 = 0 THEN 'mathpix' END AS hint FROM d)
SELECT path, hint, coalesce(hint, provider) AS provider, CASE WHEN NOT valid THEN 'invalid JSON' WHEN coalesce(hint, provider) IS NULL THEN 'unknown schema' WHEN ambiguous AND hint IS NULL THEN 'ambiguous schema' END AS error FROM h""")
def hinted_sidecars(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    name, path = F.concat(F.lit("f"), p, F.lit(".json")), F.concat(F.lit("/in/"), p % 10, F.lit("/f"), p, F.lit(".json"))
    found = part.select(path.alias("path"), F.when(s % 4 != 0, "olmocr").alias("provider"), (s % 5 == 0).alias("ambiguous"), (s % 7 != 0).alias("valid"))
    hints = part.where(p % 3 == 0).select(path.alias("path"), F.lit("mineru").alias("hint")).union(part.where(p % 5 == 0).select(name, F.lit("mathpix")))
    return payloads.hinted(found, hints, strict=True).select("path", "hint", "provider", "error")


@query("""WITH s AS (SELECT p_partkey AS k, '/d/s' || p_partkey || '.pdf' AS path FROM part) SELECT path, CASE WHEN k % 7 = 0 THEN '/own/' || k WHEN k % 2 = 0 THEN path || '.olmocr.json' WHEN k % 3 = 0 THEN '/d/s' || k || '.olmocr.json' WHEN k % 5 = 0 THEN '/d/s' || k || '.olmocr.jsonl' ELSE path END AS sidecar FROM s""")
def sidecar_paths(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    stem = F.concat(F.lit("/d/s"), k)
    sources = part.select(F.concat(stem, F.lit(".pdf")).alias("path"), F.when(k % 7 == 0, F.concat(F.lit("/own/"), k)).alias("configured"))
    files = part.where(k % 2 == 0).select(F.concat(stem, F.lit(".pdf.olmocr.json")).alias("path")).union(part.where(k % 3 == 0).select(F.concat(stem, F.lit(".olmocr.json")))).union(part.where(k % 5 == 0).select(F.concat(stem, F.lit(".olmocr.jsonl"))))
    return payloads.sidecar_path(sources, files, "olmocr")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN 'image/png' END AS media_type, CASE WHEN p_partkey % 4 <> 3 THEN sha256(p_name) END AS sha256 FROM part""")
def data_images(spark, sf_dir):
    k = F.col("p_partkey")
    body = F.base64(F.col("p_name").cast("binary"))
    source = F.when(k % 4 == 3, F.lit("images/a.png")).when(k % 4 == 2, F.concat(F.lit("DATA:image/PNG;base64,"), F.substring(body, 1, 4), F.lit("\n "), F.substring(body, F.lit(5), F.length(body)))).otherwise(F.concat(F.lit("data:image/png;base64,"), body))
    rows = table(spark, sf_dir, "part").select(k, source.alias("source"))
    return payloads.data_images(rows, "source").select("p_partkey", "media_type", "sha256")


@query(r"""WITH h AS (SELECT page_id, html || '<p><IMG alt="One & two" src=''/a.png'' width="40%"><img src="" alt=x><img style="float:left; TEXT-ALIGN: Center" width="140%" src=" b.png "/></p>' AS html FROM pages),
m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<img\b([^>]*)/?>', 1)) AS a, generate_subscripts(regexp_extract_all(html, '(?i)<img\b([^>]*)/?>', 1), 1) - 1 AS ordinal FROM h),
v AS (SELECT page_id, ordinal, trim(regexp_extract(a, '(?is)\bsrc\s*=\s*(?:"(.*?)"|''(.*?)'')', 1) || regexp_extract(a, '(?is)\bsrc\s*=\s*(?:"(.*?)"|''(.*?)'')', 2)) AS src, trim(regexp_extract(a, '(?is)\balt\s*=\s*(?:"(.*?)"|''(.*?)'')', 1) || regexp_extract(a, '(?is)\balt\s*=\s*(?:"(.*?)"|''(.*?)'')', 2)) AS alt,
  regexp_extract(a, '(?is)\bstyle\s*=\s*"(.*?)"', 1) AS style, regexp_extract(a, '(?is)\bwidth\s*=\s*"\s*(\d{1,3})%\s*"', 1) AS w FROM m)
SELECT page_id, ordinal::INTEGER AS ordinal, src, alt, nullif(lower(regexp_extract(style, '(?i)text-align\s*:\s*(left|center|right|justify)', 1)), '') AS alignment, least(100, try_cast(w AS INTEGER)) AS width_percent FROM v WHERE src <> ''""")
def html_images(spark, sf_dir):
    more = """<p><IMG alt="One & two" src='/a.png' width="40%"><img src="" alt=x><img style="float:left; TEXT-ALIGN: Center" width="140%" src=" b.png "/></p>"""
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit(more)).alias("html"))
    return payloads.html_images(rows, "html").drop("html")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE trim(text) <> '')
SELECT doc_id, i::INTEGER AS block_index, k AS reading_order, round(k * (1000.0 / n), 6) AS y0, round((k + 1) * (1000.0 / n), 6) AS y1 FROM b""")
def markdown_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_index", "text")).where(F.trim("text") != "")
    return payloads.markdown_bands(rows, "doc_id").select("doc_id", "block_index", F.col("reading_order").cast("long").alias("reading_order"), F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query(f"""WITH {LINES_SQL}, n AS (SELECT l_orderkey // 6 AS doc_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, dense_rank() OVER (PARTITION BY l_orderkey // 6 ORDER BY l_orderkey) AS page_number FROM lines)
SELECT doc_id, page_number::INTEGER AS page_number, 'page ' || l_orderkey AS markdown, 'text' AS label, 'w' || l_partkey AS text, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE l_linenumber - 1 END::INTEGER AS reading_order, l_suppkey::DOUBLE AS x0, l_suppkey + q::DOUBLE AS x1 FROM n""")
def layout_pages(spark, sf_dir):
    """Saved answers of a layout service, one line an order."""
    b = F.struct(
        F.col("l_linenumber").alias("n"), F.lit("text").alias("block_label"), F.concat(F.lit("w"), "l_partkey").alias("block_content"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("block_order"),
        F.array(F.col("l_suppkey").cast("double"), F.lit(0.0), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).cast("double"), F.lit(9.0)).alias("block_bbox"),
    )
    rows = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(b)).alias("b"))
    page = F.struct(F.struct(F.col("b").alias("parsing_res_list")).alias("prunedResult"), F.struct(F.concat(F.lit("page "), "l_orderkey").alias("text")).alias("markdown"))
    made = rows.select(F.floor(F.col("l_orderkey") / 6).alias("doc_id"), F.col("l_orderkey").alias("line"), F.to_json(F.struct(F.struct(F.array(page).alias("layoutParsingResults")).alias("result"))).alias("payload"))
    return payloads.layout_pages(made).select("doc_id", "page_number", "markdown", "label", "text", "reading_order", "x0", "x1")


@query(f"""WITH {LINES_SQL}, p AS (SELECT l_orderkey * 10 + l_linenumber AS proposal_id, l_partkey % 40 AS object_id, l_suppkey % 3 = 0 AS moves, CASE l_suppkey % 4 WHEN 0 THEN 's' || (l_partkey % 40) WHEN 1 THEN 'eng:s' || (l_partkey % 40) ELSE 'other' END AS candidate, 't' || (l_partkey % 40 + l_linenumber % 2) AS value FROM lines)
SELECT proposal_id, CASE WHEN object_id >= 30 THEN 'unknown object' WHEN candidate = 'other' THEN 'unknown text candidate' ELSE 'text differs from the candidate' END AS reason FROM p WHERE object_id >= 30 OR (NOT moves AND (candidate = 'other' OR value <> 't' || object_id))""")
def rejected_proposals(spark, sf_dir):
    o = F.col("l_partkey") % 40
    rows = lines(spark, sf_dir).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("proposal_id"), o.alias("object_id"), F.when(F.col("l_suppkey") % 3 == 0, "move").otherwise("select_text_candidate").alias("operation"),
        F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("s"), o)).when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit("eng:s"), o)).otherwise("other").alias("candidate"), F.concat(F.lit("t"), o + F.col("l_linenumber") % 2).alias("value"),
    )
    objects = spark.range(30).select(F.col("id").alias("object_id"))
    candidates = objects.select("object_id", F.lit("eng").alias("engine"), F.concat(F.lit("s"), "object_id").alias("source_element_id"), F.concat(F.lit("t"), "object_id").alias("text"))
    return payloads.rejected_proposals(rows, objects, candidates).select("proposal_id", "reason")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0 THEN 'mode' WHEN s_suppkey % 5 = 0 THEN 'saved evidence only' WHEN s_suppkey % 7 = 0 THEN 'no geometry' END AS reason FROM supplier""")
def eligible_providers(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(s, F.when(s % 4 == 0, F.array(F.lit("local"), F.lit("cloud"))).when(s % 3 == 0, F.array(F.lit("cloud"))).otherwise(F.array(F.lit("local"))).alias("modes"), (s % 5 != 0).alias("live"), (s % 7 != 0).alias("boxes"))
    return payloads.eligible(rows, "local", True).select("s_suppkey", "reason")


@query("""WITH c AS (SELECT c_custkey, 'tags' AS section, 'languages' AS name, c_mktsegment AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'features', 'tables', 'false' FROM customer WHERE c_custkey % 2 = 0), b(section, name, value) AS (VALUES ('features', 'tables', 'true'), ('features', 'formulas', 'true'), ('tags', 'languages', 'en')),
k AS (SELECT c_custkey, b.* FROM customer, b) SELECT k.c_custkey AS case_id, k.section, k.name, coalesce(c.value, k.value) AS value FROM k LEFT JOIN c ON c.c_custkey = k.c_custkey AND c.section = k.section AND c.name = k.name""")
def manifest_options(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("section", "name", "value")]
    cases = rows.where(k % 3 == 0).select(k.alias("case_id"), F.lit("tags").alias("section"), F.lit("language").alias("name"), F.col("c_mktsegment").alias("value"))
    cases = cases.union(rows.where(k % 2 == 0).select(k, F.lit("features"), F.lit("tables"), F.lit("false"))).union(rows.select(k, *nothing))
    base = spark.createDataFrame([("features", "tables", "true"), ("features", "formulas", "true"), ("tags", "language", "en")], "section string, name string, value string")
    return payloads.manifest_options(cases, base)


OPAQUE = """'source-' || substr(sha256('{"id":' || page_id || '}'), 1, 16)"""


@query(f"""WITH {OBS_SQL}, o AS (SELECT page_id, element_id, {OPAQUE} AS source_id FROM obs), e AS (SELECT *, 'element-' || substr(sha256('{{"identity":"' || element_id || '","page":1,"source":"' || source_id || '"}}'), 1, 24) AS opaque_id FROM o)
SELECT page_id, element_id, printf('block-%06d', element_id + 1) AS block_id, source_id, opaque_id, sha256('{{"block_id":"' || printf('block-%06d', element_id + 1) || '","element_ids":["' || opaque_id || '"],"end":' || (element_id + 1) || ',"origin":"text","page_number":1,"source_id":"' || source_id || '","start":' || element_id || '}}') AS candidate_id FROM e""")
def opaque_ids(spark, sf_dir):
    rows, e = observations(spark, sf_dir), F.col("element_id")
    rows = rows.select("page_id", e, ids.opaque_block(e).alias("block_id"), ids.opaque_source(F.to_json(F.struct(F.col("page_id").alias("id")))).alias("source_id"))
    rows = rows.withColumn("opaque_id", ids.opaque_element(F.col("source_id"), F.lit(1), e.cast("string")))
    return rows.withColumn("candidate_id", ids.opaque_candidate(F.col("block_id"), F.array("opaque_id"), F.lit(1), F.col("source_id"), e, e + 1, F.lit("text")))


NAMES = [" .JPG", "tif", "Azure-Doc", "..png ", "TIFF", "jpeg"]


@query(f"""SELECT p_partkey, v AS token, CASE v WHEN 'jpg' THEN 'jpeg' WHEN 'tif' THEN 'tiff' ELSE v END AS input_format FROM (SELECT p_partkey, replace(ltrim(lower(trim({NAMES}[p_partkey % 6 + 1])), '.'), '-', '_') AS v FROM part)""")
def input_formats(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", t.token(said).alias("token"), t.input_format(said).alias("input_format"))


@query(r"""SELECT p_partkey, 'cannot open ' || CASE p_partkey % 3 WHEN 0 THEN 'scan' || p_partkey || '.pdf' WHEN 1 THEN '"up.png"' ELSE '/home/x/y.pdf' END || ', giving up' AS message FROM part""")
def redacted_messages(spark, sf_dir):
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("/tmp/job-1/in/scan"), k, F.lit(".pdf"))).when(k % 3 == 1, '"/tmp/up.png"').otherwise("/home/x/y.pdf")
    return table(spark, sf_dir, "part").select(k, t.without_roots(F.concat(F.lit("cannot open "), said, F.lit(", giving up")), ["/tmp"]).alias("message"))


@query("""WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN reverse(p_name) ELSE replace(p_name, 'e', 'x') || '{}' END AS b FROM part),
c AS (SELECT p_partkey, 1 AS s, unnest(string_split(replace(a, ' ', ''), '')) AS ch FROM p UNION ALL SELECT p_partkey, -1, unnest(string_split(replace(replace(replace(b, ' ', ''), '{', ''), '}', ''), '')) FROM p), n AS (SELECT p_partkey, ch, sum(s) AS d FROM c GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN bool_and(d = 0) THEN 'agree' ELSE 'disagree' END AS status, coalesce(string_agg(repeat(ch, d::BIGINT), '' ORDER BY ch) FILTER (d > 0), '') AS left_only, coalesce(string_agg(repeat(ch, (-d)::BIGINT), '' ORDER BY ch) FILTER (d < 0), '') AS right_only FROM n GROUP BY 1""")
def math_cross_checks(spark, sf_dir):
    """Two visible readings of a formula as multisets of their characters."""
    k, name = F.col("p_partkey"), F.col("p_name")
    other = F.when(k % 3 == 0, F.reverse(name)).otherwise(F.concat(F.replace(name, F.lit("e"), F.lit("x")), F.lit("{}")))
    return table(spark, sf_dir, "part").select(k, t.character_check(name, other).alias("c")).select("p_partkey", "c.*")
