"""Saved results of nine schemas: payloads are made from the lines of orders, and SQL says what elements, cells and fields they
hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import LINES_SQL, ORDER, table
from ..registry import query
from ..sources import sniff, tables

L = "L"


def grouped(spark, sf_dir):
    """A document an order: its lines as an array of n (from 1), p, s and q. One sort numbers them and lists them."""
    order = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    one = F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("q"))
    every = F.collect_list(one).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("_n"), every.alias("L")).where("_n = 1")
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.transform("L", lambda x, i: F.struct((i + 1).alias("n"), x["p"].alias("p"), x["s"].alias("s"), x["q"].alias("q"))).alias("L"))


LINED = f"{LINES_SQL}, l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q FROM lines)"


def _text(prefix, c):
    return F.concat(F.lit(prefix), c.cast("string"))


def _fields(**columns):
    return F.struct(*[c.alias(k) if hasattr(c, "alias") else F.lit(c).alias(k) for k, c in columns.items()])


def _null(kind):
    return F.lit(None).cast(kind)


def _said(pattern, *values):
    """The pattern with each % replaced by a value; null if one is."""
    # JSON of payloads is written in pieces; lists of structs, made and then written, take several times as long.
    first, *others = pattern.split("%")
    return F.concat(F.lit(first), *[c for v, part in zip(values, others, strict=True) for c in (v.cast("string"), F.lit(part))])


def _members(*pieces):
    """Members of an object; those that are null are left out."""
    return F.concat_ws(",", *pieces)


def _each(item, lines=L):
    return F.array_join(F.transform(lines, item), ",")


def textract_payload():
    def blocks(x):
        n = x["n"]
        box = _members(_said('"Left":%', (x["p"] % 8) / 8), _said('"Top":%', (x["s"] % 8) / 8), F.lit('"Width":0.125,"Height":0.0625'))
        place = _said('"Geometry":{"BoundingBox":{%}}', box)
        line = _members(_said('{"Id":"L%","BlockType":"LINE"', n), F.when(n % 2 == 0, _said('"Text":"line %"', n)), _said('"Confidence":%', x["q"].cast("double")), place, _said('"Relationships":[{"Type":"CHILD","Ids":["W%a","W%b"]}]}', n, n))
        word = lambda end, pattern, text: _members(_said(f'{{"Id":"W%{end}","BlockType":"WORD"', n), _said(pattern, text), place, F.lit('"Relationships":[]}'))
        return _members(line, word("a", '"Text":"w%"', x["p"]), word("b", '"Text":"x%"', x["s"]))

    return _said('{"Blocks":[%]}', _each(blocks))


def azure_payload():
    def paragraph(x):
        n, x0, y0 = x["n"], (x["p"] % 50).cast("double"), (x["s"] % 70).cast("double")
        corners = [F.coalesce(v.cast("string"), F.lit("null")) for v in (x0, y0, x0 + 10, y0, x0 + 10, y0 + 5, x0, y0 + 5)]
        role = F.when(n % 3 == 0, '"role":"title"').when(n % 3 == 2, '"role":"pageHeader"')
        rest = _said('"spans":[{"offset":%,"length":9}],"boundingRegions":[{"pageNumber":%,"polygon":[%]}]', 10 * n - 10, 1 + n % 2, F.concat_ws(",", *corners))
        return F.concat(F.lit("{"), _members(_said('"content":"para %"', x["p"]), role, rest), F.lit("}"))

    words = lambda x: _said('{"confidence":0.5,"span":{"offset":%,"length":4}},{"confidence":%,"span":{"offset":%,"length":4}}', 10 * x["n"] - 10, F.when(x["s"] % 2 == 0, 0.25).otherwise(0.75), 10 * x["n"] - 5)

    def cell(x):
        first = _said('"rowIndex":%,"columnIndex":%', F.floor((x["n"] - 1) / 2), (x["n"] - 1) % 2)
        return F.concat(F.lit("{"), _members(first, F.when(x["p"] % 5 == 0, '"rowSpan":2'), _said('"content":"cell %"', x["p"]), F.when(x["n"] <= 2, '"kind":"columnHeader"')), F.lit("}"))

    return _said('{"analyzeResult":{"paragraphs":[%],"pages":[{"pageNumber":1,"words":[%]}],"tables":[{"cells":[%]}]}}', _each(paragraph), _each(words), _each(cell))


def google_payload():
    whole = F.array_join(F.transform(L, lambda x: F.concat(_text("item", x["n"] % 10), F.lit(" "))), "")
    anchor = lambda x: _said('"textAnchor":{"textSegments":[{"startIndex":"%","endIndex":"%"}]}', 6 * x["n"] - 6, 6 * x["n"])
    corner = lambda x, dx, dy: _said("{%}", _members(_said('"x":%', (x["p"] % 8) / 8 + dx), _said('"y":%', (x["s"] % 8) / 8 + dy)))
    corners = lambda x: _members(corner(x, 0.125, 0.0), corner(x, 0.0, 0.0625), corner(x, 0.125, 0.0625))
    paragraph = lambda x: _said('{"layout":{%}}', _members(_said('"confidence":%', x["q"] / 64), anchor(x), _said('"boundingPoly":{"normalizedVertices":[%]}', corners(x))))
    cell = lambda x: _said("{%}", _members(F.lit('"rowSpan":1'), F.when(x["p"] % 5 == 0, '"colSpan":2'), _said('"layout":{%}', anchor(x))))
    field = lambda x: _said('{"fieldName":{"textAnchor":{%}},"fieldValue":{%}}', F.coalesce(_said('"content":"name % :\\n"', x["p"]), F.lit("")), anchor(x))
    heads, rest = _each(cell, F.filter(L, lambda x: x["n"] <= 2)), _each(cell, F.filter(L, lambda x: x["n"] > 2))
    page = _said('"paragraphs":[%],"tables":[{"headerRows":[{"cells":[%]}],"bodyRows":[{"cells":[%]}]}],"formFields":[%]', _each(paragraph), heads, rest, _each(field))
    return _said('{"document":{"text":"%","pages":[{"pageNumber":3,"dimension":{"width":800.0,"height":1600.0},%}]}}', whole, page)


def other_payloads():
    x0, y0 = (lambda x: (x["p"] % 50).cast("double")), (lambda x: (x["s"] % 70).cast("double"))
    mathpix = lambda x: _fields(id=_text("m", x["n"]), type=F.when(x["n"] % 2 == 0, "equation").otherwise("text"), text=_text("t", x["p"]), confidence=x["q"] / 64, cnt=F.array(F.array(x0(x) + 9, y0(x)), F.array(x0(x), y0(x) + 4), F.array(x0(x) + 2, y0(x) + 1)))
    mineru = lambda x: _fields(page_idx=x["n"] % 3, type=F.when(x["n"] % 2 == 0, "table").otherwise("text"), text=_text("c", x["p"]), text_level=F.when(x["n"] % 4 == 1, 1), bbox=F.array(x0(x), y0(x), x0(x) + 8, y0(x) + 3))
    element = lambda x: _fields(id=_text("e", x["n"]), type="paragraph", text=_text("k", x["p"]), confidence=x["q"] / 64, bbox=_fields(x0=x0(x), y0=y0(x), x1=x0(x) + 7, y1=y0(x) + 2))
    return {
        "mathpix": F.to_json(_fields(pages=F.array(_fields(page=4, lines=F.transform(L, mathpix))))),
        "mineru": F.to_json(_fields(_backend="pipeline", content_list=F.transform(L, mineru))),
        "paddleocr": F.to_json(_fields(rec_texts=F.transform(L, lambda x: _text("r", x["p"])), rec_scores=F.transform(L, lambda x: x["q"] / 64), rec_boxes=F.transform(L, lambda x: F.array(x0(x), y0(x), x0(x) + 6, y0(x) + 2)))),
        "olmocr": F.to_json(_fields(natural_text=_text("whole ", F.col("doc_id")), page_number=F.size(L))),
        "mistral_ocr": F.to_json(_fields(model="mistral-ocr-latest", pages=F.transform(L, lambda x: _fields(index=x["n"] - 1, markdown=_text("# p", x["p"]))))),
        "canonical": F.to_json(_fields(schema_version="0.1", id=_text("d", F.col("doc_id")), pages=F.array(_fields(number=2, width=100.0, height=100.0, elements=F.transform(L, element))))),
    }


PROVIDERS = ["aws_textract", "azure_document_intelligence", "google_document_ai", "mathpix", "mineru", "paddleocr", "olmocr", "mistral_ocr", "canonical"]


def payload_rows(spark, sf_dir):
    every = {"aws_textract": textract_payload(), "azure_document_intelligence": azure_payload(), "google_document_ai": google_payload(), **other_payloads()}
    body = F.lit(None).cast("string")
    for k, name in enumerate(PROVIDERS):
        body = F.when(F.col("doc_id") % 9 == k, every[name]).otherwise(body)
    return grouped(spark, sf_dir).select("doc_id", F.explode(F.array(body)).alias("payload"))


ELEMENTS = f"""{LINED}, b AS (SELECT *, (p % 50)::DOUBLE AS x, (s % 70)::DOUBLE AS y, (p % 8) / 8 AS fx, (s % 8) / 8 AS fy, q / 64 AS c, doc_id % 9 AS k FROM l)
SELECT doc_id, 1 AS page_number, 'L' || n AS element_id, 'text' AS kind, fx AS x0, fy AS y0, fx + 0.125 AS x1, fy + 0.0625 AS y1, CASE WHEN n % 2 = 0 THEN 'line ' || n ELSE 'w' || p || ' x' || s END AS text, q / 100 AS confidence FROM b WHERE k = 0
UNION ALL SELECT doc_id, 1 + n % 2, 'p' || (n - 1), CASE n % 3 WHEN 0 THEN 'title' WHEN 2 THEN 'header' ELSE 'paragraph' END, x, y, x + 10, y + 5, 'para ' || p, (0.5 + CASE WHEN s % 2 = 0 THEN 0.25 ELSE 0.75 END) / 2 FROM b WHERE k = 1
UNION ALL SELECT doc_id, 3, 'p3-' || (n - 1), 'paragraph', fx * 800, fy * 1600, (fx + 0.125) * 800, (fy + 0.0625) * 1600, 'item' || (n % 10), c FROM b WHERE k = 2
UNION ALL SELECT doc_id, 4, 'm' || n, CASE WHEN n % 2 = 0 THEN 'formula' ELSE 'text' END, x, y, x + 9, y + 4, 't' || p, c FROM b WHERE k = 3
UNION ALL SELECT doc_id, n % 3 + 1, 'c' || (n - 1), CASE WHEN n % 4 = 1 THEN 'heading' WHEN n % 2 = 0 THEN 'table' ELSE 'text' END, x, y, x + 8, y + 3, 'c' || p, NULL FROM b WHERE k = 4
UNION ALL SELECT doc_id, 1, 'e' || (n - 1), 'text', x, y, x + 6, y + 2, 'r' || p, c FROM b WHERE k = 5
UNION ALL SELECT doc_id, count(*), 'page', 'text', NULL, NULL, NULL, NULL, 'whole ' || doc_id, NULL FROM b WHERE k = 6 GROUP BY doc_id
UNION ALL SELECT doc_id, n, 'page-' || n, 'text', NULL, NULL, NULL, NULL, '# p' || p, NULL FROM b WHERE k = 7
UNION ALL SELECT doc_id, 2, 'e' || n, 'paragraph', x, y, x + 7, y + 2, 'k' || p, c FROM b WHERE k = 8"""


@query(f"WITH {ELEMENTS}")
def normalised_elements(spark, sf_dir):
    """Elements of nine schemas, told apart by their fields."""
    return sniff.normalize(payload_rows(spark, sf_dir)).withColumn("page_number", F.col("page_number").cast("int"))


@query(f"SELECT l_orderkey AS doc_id, {PROVIDERS}[l_orderkey % 9 + 1] AS provider, CASE l_orderkey % 9 WHEN 3 THEN 0.96 WHEN 4 THEN 0.97 WHEN 6 THEN 0.97 WHEN 7 THEN 0.98 WHEN 8 THEN 1.0 ELSE 0.99 END::DOUBLE AS confidence, false AS ambiguous FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def detected_providers(spark, sf_dir):
    return sniff.detect(payload_rows(spark, sf_dir)).select("doc_id", "provider", "confidence", "ambiguous")


def textract_graph(spark, sf_dir):
    """Block graphs with a table and a form: a cell and a field a line."""

    def blocks(x):
        n, maybe = x["n"], lambda pattern, *v: F.coalesce(_said(pattern, *v), F.lit(""))
        span = F.when(x["p"] % 5 == 0, ',"ColumnSpan":2').otherwise("")
        header = F.when(n <= 2, '"COLUMN_HEADER"').otherwise("")
        return F.concat(
            _said('{"Id":"C%","BlockType":"CELL","RowIndex":%,"ColumnIndex":%%,"EntityTypes":[%],"Relationships":[{"Type":"CHILD","Ids":["W%","S%"]}]}', n, F.floor((n - 1) / 2) + 1, (n - 1) % 2 + 1, span, header, n, n),
            _said(',{"Id":"W%","BlockType":"WORD","EntityTypes":[]%,"Relationships":[]}', n, maybe(',"Text":"w%"', x["p"])),
            _said(',{"Id":"S%","BlockType":"SELECTION_ELEMENT","EntityTypes":[],"SelectionStatus":"%","Relationships":[]}', n, F.when(x["s"] % 2 == 0, "SELECTED").otherwise("NOT_SELECTED")),
            _said(',{"Id":"K%","BlockType":"KEY_VALUE_SET","EntityTypes":["KEY"],"Relationships":[{"Type":"CHILD","Ids":["W%"]},{"Type":"VALUE","Ids":["V%"]}]}', n, n, n),
            _said(',{"Id":"V%","BlockType":"KEY_VALUE_SET","EntityTypes":["VALUE"],"Relationships":[{"Type":"CHILD","Ids":["S%","W%"]}]}', n, n, n),
        )

    cells = F.array_join(F.transform(L, lambda x: _said('"C%"', x["n"])), ",")
    rest = F.array_join(F.transform(L, blocks), ",")
    return grouped(spark, sf_dir).select("doc_id", _said('{"Blocks":[{"Id":"T","BlockType":"TABLE","EntityTypes":[],"Relationships":[{"Type":"CHILD","Ids":[%]}]},%]}', cells, rest).alias("payload"))


@query(f"""WITH {LINED} SELECT doc_id, 'T' AS table_id, (n - 1) // 2 AS "row", (n - 1) % 2 AS "column", 1 AS row_span, CASE WHEN p % 5 = 0 THEN 2 ELSE 1 END AS column_span, 'w' || p || CASE WHEN s % 2 = 0 THEN ' ☒' ELSE '' END AS text, n <= 2 AS is_header FROM l""")
def textract_cells(spark, sf_dir):
    return tables.textract_cells(textract_graph(spark, sf_dir))


@query(f"WITH {LINED} SELECT doc_id, 'K' || n AS field_id, 'w' || p AS name, CASE WHEN s % 2 = 0 THEN '☒ ' ELSE '' END || 'w' || p AS value FROM l")
def textract_fields(spark, sf_dir):
    return tables.textract_fields(textract_graph(spark, sf_dir))


@query(f"""WITH {LINED} SELECT doc_id, 't0' AS table_id, (n - 1) // 2 AS "row", (n - 1) % 2 AS "column", CASE WHEN p % 5 = 0 THEN 2 ELSE 1 END AS row_span, 1 AS column_span, 'cell ' || p AS text, n <= 2 AS is_header FROM l""")
def azure_cells(spark, sf_dir):
    return tables.azure_cells(grouped(spark, sf_dir).select("doc_id", azure_payload().alias("payload")))


@query(f"""WITH {LINED}, w AS (SELECT *, CASE WHEN p % 5 = 0 THEN 2 ELSE 1 END AS span, n > 2 AS body FROM l)
SELECT doc_id, 'p0t0' AS table_id, body::INTEGER AS "row", coalesce(sum(span) OVER (PARTITION BY doc_id, body ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS "column", 1 AS row_span, span AS column_span, 'item' || (n % 10) AS text, NOT body AS is_header FROM w""")
def google_cells(spark, sf_dir):
    return tables.google_cells(grouped(spark, sf_dir).select("doc_id", google_payload().alias("payload")))


@query(f"WITH {LINED} SELECT doc_id, 'p0f' || (n - 1) AS field_id, 'name ' || p AS name, 'item' || (n % 10) AS value FROM l")
def google_fields(spark, sf_dir):
    return tables.google_fields(grouped(spark, sf_dir).select("doc_id", google_payload().alias("payload")))


@query(f"""WITH {LINED}, c AS (SELECT doc_id, (n - 1) // 2 AS r, string_agg('cell ' || p, ' | ' ORDER BY n) AS line, count(*) AS k FROM l GROUP BY 1, 2), m AS (SELECT doc_id, max(n) AS most, max((n - 1) // 2 + CASE WHEN p % 5 = 0 THEN 2 ELSE 1 END) AS h FROM l GROUP BY 1),
rows AS (SELECT m.doc_id, g.r, CASE WHEN most = 1 THEN coalesce(line, '') ELSE coalesce(CASE WHEN k = 1 THEN line || ' | ' ELSE line END, ' | ') END AS line, CASE WHEN most = 1 THEN '| --- |' ELSE '| --- | --- |' END AS rule FROM m JOIN (SELECT unnest(range(0, 20)) AS r) g ON g.r < h LEFT JOIN c ON c.doc_id = m.doc_id AND c.r = g.r)
SELECT doc_id, 't0' AS table_id, string_agg('| ' || line || ' |' || CASE WHEN r = 0 THEN chr(10) || rule ELSE '' END, chr(10) ORDER BY r) AS markdown FROM rows GROUP BY 1""")
def cells_markdown(spark, sf_dir):
    return tables.cells_markdown(tables.azure_cells(grouped(spark, sf_dir).select("doc_id", azure_payload().alias("payload"))))
