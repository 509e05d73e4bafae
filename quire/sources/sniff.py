"""Saved recognition results: JSON of several schemas, told apart by their fields, to one table of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import element_type
from . import graph

THRESHOLD, MARGIN = 0.60, 0.05


def _has(path: str) -> Column:
    """Whether a payload holds something there. The names at its top (``_keys``) and on its first page (``_page``) were
    read once, so only payloads that have the path's names are read again."""
    first = path.removeprefix("$.").split(".")[0].split("[")[0]
    there = F.array_contains("_keys", first)
    if path.startswith("$.pages[0]."):
        there = there & F.array_contains("_page", path.removeprefix("$.pages[0].").split("[")[0])
    return there & F.get_json_object("payload", path).isNotNull()


# A schema's name, its markers and the confidence that they give, best first within a schema.
def _rules() -> list[tuple[str, Column, float]]:
    return [
        ("canonical", _has("$.schema_version") & (F.get_json_object("payload", "$.schema_version") == "0.1") & _has("$.pages") & _has("$.id"), 1.0),
        ("canonical", _has("$.id") & _has("$.pages[0].elements") & _has("$.pages[0].number") & _has("$.pages[0].width"), 0.98),
        ("aws_textract", _has("$.Blocks[0].BlockType") | ((_has("$.AnalyzeDocumentModelVersion") | _has("$.DetectDocumentTextModelVersion")) & _has("$.Blocks")), 0.99),
        ("aws_textract", _has("$.Blocks"), 0.86),
        ("azure_document_intelligence", _has("$.analyzeResult"), 0.99),
        ("azure_document_intelligence", _has("$.result.analyzeResult") | _has("$.data.analyzeResult") | _has("$.response.analyzeResult"), 0.98),
        ("azure_document_intelligence", (_has("$.apiVersion") | _has("$.modelId") | _has("$.paragraphs") | _has("$.styles")) & _has("$.pages"), 0.91),
        ("google_document_ai", _has("$.document.pages[0].layout") | _has("$.document.pages[0].dimension"), 0.99),
        ("google_document_ai", _has("$.pages[0].layout") | _has("$.pages[0].dimension"), 0.93),
        ("mistral_ocr", _has("$.model") & F.lower(F.get_json_object("payload", "$.model")).contains("mistral") & _has("$.pages"), 0.98),
        ("mistral_ocr", _has("$.pages[0].markdown") & _has("$.pages[0].index"), 0.95),
        ("mathpix", _has("$.pages[0].lines[0].cnt") | _has("$.pages[0].lines[0].text_display"), 0.96),
        ("mineru", _has("$.pdf_info") | _has("$._backend"), 0.97),
        ("mineru", _has("$.pages[0].para_blocks") | _has("$.pages[0].content_list"), 0.92),
        ("paddleocr", _has("$.rec_texts") & (_has("$.rec_boxes") | _has("$.rec_polys") | _has("$.dt_polys")), 0.99),
        ("paddleocr", _has("$.ocr_results"), 0.94),
        ("olmocr", _has("$.natural_text"), 0.97),
        ("olmocr", _has("$.completion") & _has("$.metadata"), 0.90),
    ]


def detect(payloads: DataFrame) -> DataFrame:
    """Add provider (null below the threshold), confidence and ambiguous (a second schema within the margin) to rows with a
    JSON text ``payload``. A payload that is no JSON has confidence 0."""
    best: dict[str, Column] = {}
    for name, rule, confidence in reversed(_rules()):
        best[name] = F.when(rule, F.lit(confidence)).otherwise(best.get(name, F.lit(None).cast("double")))
    found = F.filter(F.array(*[F.struct((-c).alias("c"), F.lit(n).alias("provider")) for n, c in best.items()]), lambda x: x["c"].isNotNull())
    rows = payloads.withColumn("_keys", F.json_object_keys("payload"))
    page = F.when(F.array_contains("_keys", "pages"), F.json_object_keys(F.get_json_object("payload", "$.pages[0]")))
    rows = rows.withColumn("_page", page).withColumn("_found", F.array_sort(found))
    top, second = -F.get("_found", F.lit(0))["c"], -F.get("_found", F.lit(1))["c"]
    said = F.struct(F.coalesce(top, F.lit(0.0)).alias("confidence"), F.when(top >= THRESHOLD, F.get("_found", F.lit(0))["provider"]).alias("provider"), F.coalesce(top - second <= MARGIN, F.lit(False)).alias("ambiguous"))
    # The array keeps conditions on the results above the detection: below, it would be worked out for each of them.
    return rows.select(*payloads.columns, F.explode(F.array(said)).alias("_said")).select(*payloads.columns, "_said.*")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as rows: path, payload (a byte order mark dropped)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("payload"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as rows: path, payload and valid; lines that are no JSON are kept and marked."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return rows.withColumn("valid", F.try_parse_json("payload").isNotNull())


_BLOCK = "array<struct<Id:string,BlockType:string,Page:int,Text:string,Confidence:double,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>,Relationships:array<struct<Type:string,Ids:array<string>>>>>"
ELEMENTS = ["doc_id", "page_number", "element_id", "kind", "x0", "y0", "x1", "y1", "text", "confidence"]


def _nothing() -> Column:
    return F.lit(None).cast("double")


def _element(page_number: Column, element_id: Column, kind: Column, box, text: Column, confidence: Column) -> Column:
    values = (page_number.cast("int"), element_id, kind, *box, text, confidence)
    return F.struct(*[v.alias(n) for n, v in zip(ELEMENTS[1:], values, strict=True)])


def _listed(payloads: DataFrame, elements: Column) -> DataFrame:
    return payloads.select("doc_id", F.inline(elements))


def _textract(payload: Column, width: float, height: float) -> Column:
    def line(b: Column, index: Column) -> Column:
        box = b["Geometry"]["BoundingBox"]
        corners = (box["Left"] * width, box["Top"] * height, (box["Left"] + box["Width"]) * width, (box["Top"] + box["Height"]) * height)
        words = graph.words(F.array(b), index, lambda x: x["Text"])
        return _element(F.coalesce(b["Page"], F.lit(1)), b["Id"], F.lit("text"), corners, F.coalesce(b["Text"], words), b["Confidence"] / 100)

    lines = lambda blocks: F.filter(blocks, lambda b: b["BlockType"] == "LINE")
    return graph.once(graph.parsed(payload, "Blocks", _BLOCK), lambda blocks: graph.indexed(blocks, lambda index: F.transform(lines(blocks), lambda b: line(b, index))))


def textract(payloads: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """Lines of block graphs: text is the line's own, else its words' in order; confidences are per cent; boxes are shares
    of the page."""
    return _listed(payloads, _textract(F.col("payload"), width, height))


def _recognition_arrays(payload: Column) -> Column:
    shape = "struct<rec_texts:array<string>,rec_scores:array<double>,rec_boxes:array<array<double>>>"

    def element(e: Column, n: Column) -> Column:
        box = e["rec_boxes"]
        return _element(F.lit(1), F.concat(F.lit("e"), n), F.lit("text"), [F.get(box, F.lit(i)) for i in range(4)], e["rec_texts"], e["rec_scores"])

    return F.transform(graph.once(F.from_json(payload, shape), lambda p: F.arrays_zip(*[p[c].alias(c) for c in ("rec_texts", "rec_scores", "rec_boxes")])), element)


def recognition_arrays(payloads: DataFrame) -> DataFrame:
    """Parallel arrays rec_texts, rec_scores and rec_boxes to elements."""
    return _listed(payloads, _recognition_arrays(F.col("payload")))


def _page_texts(payload: Column, path: str, text: str) -> Column:
    pages = F.from_json(F.get_json_object(payload, path), f"array<struct<`{text}`:string>>")
    return F.transform(pages, lambda p, n: _element(n + 1, F.concat(F.lit("page-"), n + 1), F.lit("text"), [_nothing()] * 4, p[text], _nothing()))


def page_texts(payloads: DataFrame, path: str, text: str) -> DataFrame:
    """Page records with whole texts (as in pages[].markdown) to one element a page, without geometry."""
    return _listed(payloads, _page_texts(F.col("payload"), path, text))


def _polygon(points, odd: int, pick):
    return pick(F.filter(points, lambda x, i: i % 2 == odd))


def _azure_paragraphs(payload: Column) -> Column:
    shape = "struct<paragraphs:array<struct<content:string,role:string,spans:array<struct<offset:int,length:int>>,boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>>>,pages:array<struct<pageNumber:int,words:array<struct<confidence:double,span:struct<offset:int,length:int>>>>>>"
    meets = lambda w, s: (w["span"]["offset"] < s["offset"] + s["length"]) & (s["offset"] < w["span"]["offset"] + w["span"]["length"])

    def paragraph(p: Column, n: Column, words: Column) -> Column:
        known = F.transform(F.filter(words, lambda w: F.exists(p["spans"], lambda s: meets(w, s))), lambda w: w["confidence"])
        mean = graph.once(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, x: a + x) / F.size(k)))
        region = F.get(p["boundingRegions"], F.lit(0))
        poly = region["polygon"]
        kind = F.when(p["role"].isNull(), "paragraph").otherwise(element_type(p["role"], "paragraph"))
        box = [_polygon(poly, odd, pick) for pick in (F.array_min, F.array_max) for odd in (0, 1)]
        return _element(F.coalesce(region["pageNumber"], F.lit(1)), F.concat(F.lit("p"), n), kind, box, p["content"], mean)

    of = lambda r: graph.once(F.flatten(F.transform(r["pages"], lambda p: p["words"])), lambda words: F.transform(r["paragraphs"], lambda p, n: paragraph(p, n, words)))
    other = F.from_json(F.coalesce(F.get_json_object(payload, "$.result.analyzeResult"), payload), shape)
    return graph.once(F.coalesce(graph.parsed(payload, "analyzeResult", shape), other), of)


def azure_paragraphs(payloads: DataFrame) -> DataFrame:
    """Paragraphs of a layout result: the role as type, the polygon's box; confidence is the mean of the words whose spans
    meet the paragraph's (half-open intervals)."""
    return _listed(payloads, _azure_paragraphs(F.col("payload")))


def _google_paragraphs(payload: Column) -> Column:
    shape = "struct<text:string,pages:array<struct<pageNumber:int,dimension:struct<width:double,height:double>,paragraphs:array<struct<layout:struct<confidence:double,textAnchor:struct<content:string,textSegments:array<struct<startIndex:string,endIndex:string>>>,boundingPoly:struct<normalizedVertices:array<struct<x:double,y:double>>>>>>>>>"
    start = lambda s: F.coalesce(s["startIndex"].try_cast("int"), F.lit(0))

    def paragraph(p: Column, n: Column, text: Column, page: Column, number: Column) -> Column:
        anchor, corners = p["layout"]["textAnchor"], p["layout"]["boundingPoly"]["normalizedVertices"]
        cut = F.array_join(F.transform(anchor["textSegments"], lambda s: F.substring(text, start(s) + 1, s["endIndex"].try_cast("int") - start(s))), "")
        at = lambda c, pick, size: pick(F.transform(corners, lambda v: F.coalesce(v[c], F.lit(0.0)))) * page["dimension"][size]
        box = (at("x", F.array_min, "width"), at("y", F.array_min, "height"), at("x", F.array_max, "width"), at("y", F.array_max, "height"))
        return _element(number, F.concat(F.lit("p"), number, F.lit("-"), n), F.lit("paragraph"), box, F.regexp_replace(F.coalesce(anchor["content"], cut), r"^\s+|\s+$", ""), p["layout"]["confidence"])

    of_page = lambda d, page, k: F.transform(page["paragraphs"], lambda p, n: paragraph(p, n, d["text"], page, F.coalesce(page["pageNumber"], k + 1)))
    return graph.once(F.coalesce(graph.parsed(payload, "document", shape), F.from_json(payload, shape)), lambda d: graph.joined(F.transform(d["pages"], lambda page, k: of_page(d, page, k))))


def google_paragraphs(payloads: DataFrame) -> DataFrame:
    """Paragraphs of a processed document: texts are slices [start, end) of the document's text, boxes normalised vertices times
    the page's size."""
    return _listed(payloads, _google_paragraphs(F.col("payload")))


def _contour_lines(payload: Column) -> Column:
    shape = "array<struct<page:int,lines:array<struct<id:string,type:string,text:string,text_display:string,confidence:double,cnt:array<array<double>>>>>>"

    def line(x: Column, n: Column, number: Column) -> Column:
        at = lambda i, pick: pick(F.transform(x["cnt"], lambda v: F.get(v, F.lit(i))))
        box = (at(0, F.array_min), at(1, F.array_min), at(0, F.array_max), at(1, F.array_max))
        own = F.coalesce(x["id"], F.concat(F.lit("l"), number, F.lit("-"), n))
        return _element(number, own, element_type(F.coalesce(x["type"], F.lit("text"))), box, F.coalesce(x["text"], x["text_display"]), x["confidence"])

    of_page = lambda g, k: F.transform(g["lines"], lambda x, n: line(x, n, F.coalesce(g["page"], k + 1)))
    return graph.joined(F.transform(graph.parsed(payload, "pages", shape), of_page))


def contour_lines(payloads: DataFrame) -> DataFrame:
    """Lines with contours (pages[].lines[].cnt) to elements."""
    return _listed(payloads, _contour_lines(F.col("payload")))


def _content_lists(payload: Column) -> Column:
    shape = "array<struct<page_idx:int,type:string,text:string,text_level:int,bbox:array<double>>>"
    flat = F.coalesce(F.from_json(F.get_json_object(payload, "$.content_list"), shape), F.flatten(F.transform(F.from_json(F.get_json_object(payload, "$.pages"), f"array<struct<content_list:{shape}>>"), lambda p: p["content_list"])))

    def element(c: Column, n: Column) -> Column:
        kind = F.when(c["text_level"].isNotNull(), "heading").otherwise(element_type(F.coalesce(c["type"], F.lit("text"))))
        return _element(F.coalesce(c["page_idx"], F.lit(0)) + 1, F.concat(F.lit("c"), n), kind, [F.get(c["bbox"], F.lit(i)) for i in range(4)], c["text"], _nothing())

    return F.transform(flat, element)


def content_lists(payloads: DataFrame) -> DataFrame:
    """Flat content lists (page_idx from 0, type, bbox, text) under pages[].content_list or at the top."""
    return _listed(payloads, _content_lists(F.col("payload")))


def _natural_texts(payload: Column) -> Column:
    text = F.coalesce(F.get_json_object(payload, "$.natural_text"), F.get_json_object(payload, "$.completion"))
    return F.array(_element(F.coalesce(F.get_json_object(payload, "$.page_number").try_cast("int"), F.lit(1)), F.lit("page"), F.lit("text"), [_nothing()] * 4, text, _nothing()))


def natural_texts(payloads: DataFrame) -> DataFrame:
    """One element for a record's whole text."""
    return _listed(payloads, _natural_texts(F.col("payload")))


def _canonical(payload: Column) -> Column:
    shape = "array<struct<number:int,elements:array<struct<id:string,type:string,text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>>>"
    element = lambda e, number: _element(number, e["id"], e["type"], [e["bbox"][c] for c in ("x0", "y0", "x1", "y1")], e["text"], e["confidence"])
    return graph.joined(F.transform(graph.parsed(payload, "pages", shape), lambda g: F.transform(g["elements"], lambda e: element(e, g["number"]))))


def canonical(payloads: DataFrame) -> DataFrame:
    """Documents of the element model itself."""
    return _listed(payloads, _canonical(F.col("payload")))


def normalize(payloads: DataFrame) -> DataFrame:
    """Elements of all payloads (doc_id, payload) whose schema is known; the others give no rows. One pass: each payload is told
    apart once and read by its own schema only."""
    # The array keeps detection and parsing above the payloads: inlined, what makes a payload would be worked out for each rule.
    whole = payloads.select("doc_id", F.explode(F.array("payload")).alias("payload"))
    p = F.col("payload")
    of = {
        "aws_textract": _textract(p, 1.0, 1.0),
        "paddleocr": _recognition_arrays(p),
        "mistral_ocr": _page_texts(p, "$.pages", "markdown"),
        "azure_document_intelligence": _azure_paragraphs(p),
        "google_document_ai": _google_paragraphs(p),
        "mathpix": _contour_lines(p),
        "mineru": _content_lists(p),
        "olmocr": _natural_texts(p),
        "canonical": _canonical(p),
    }
    elements = F
    for name, column in of.items():
        elements = elements.when(F.col("provider") == name, column)
    return _listed(detect(whole), elements)


def word_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words (box as left, top, width, height; text; conf in per cent or negative; word_num) to lines: words in order, the
    union box and the mean of the known confidences. Words without text or extent go."""
    kept = words.where("level = 5 and trim(text) <> '' and width > 0 and height > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return kept.groupBy(*keys).agg(joined.alias("text"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"), (F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100).alias("confidence"))


def read_word_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated word table, whose texts are never quoted."""
    shape = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
    return spark.read.csv(path, sep="\t", header=True, quote="", schema=shape)

