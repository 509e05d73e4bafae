"""Word packages of documents, what they hold, and pages that compare two pictures."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frames import streamed

# Fixed values of the package format: parts that every document has, and the namespace of its text.
_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _run(text: str) -> str:
    parts = _ILLEGAL.sub("", text).split("\n")
    return "<w:r>" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in parts) + "</w:r>"


def _paragraph(text: str, style: str | None = None) -> str:
    own = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{own}{_run(text)}</w:p>"


def _table(rows: list[list[str]]) -> str:
    cells = lambda row: "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in row)
    return "<w:tbl>" + "".join(f"<w:tr>{cells(r)}</w:tr>" for r in rows) + "</w:tbl><w:p/>"


def package(blocks: list[tuple[int, str, str]]) -> bytes:
    """A package of blocks (page, kind, text) in order: titles and headings with their styles, tables from rows of texts parted by
    tabs, a page break before each page but the first. The same blocks give the same bytes."""
    body, before = [], None
    for page, kind, text in blocks:
        if before is not None and page != before:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        before = page
        if kind == "table":
            body.append(_table([line.split("\t") for line in text.split("\n")]))
        else:
            body.append(_paragraph(text, {"title": "Title", "heading": "Heading1", "list_item": "ListParagraph"}.get(kind)))
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_W}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def documents_docx(elements: DataFrame, document: str, page: str, order: str = "reading_order") -> DataFrame:
    """document and content (a Word package) of elements (document, page, order, kind, text); elements without text are left
    out. A task holds one document at a time."""
    kinds = dict(elements.dtypes)
    rows = elements.where(F.length(F.coalesce("text", F.lit(""))) > 0).select(document, F.col(page).cast("long").alias(page), F.col(order).cast("long").alias(order), "kind", "text")
    work = lambda at, found: [(at, package([(p, k, t) for _, p, _, k, t in sorted(found)]))]
    return streamed(rows, document, work, f"{document} {kinds[document]}, content binary")


def _held(content: bytes | None) -> tuple:
    """(valid, paragraphs with text, tables, drawings, text) of a package."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return False, 0, 0, 0, None
    texts = []
    for p in root.iter(f"{{{_W}}}p"):
        parts = []
        for node in p.iter():
            if node.tag in (f"{{{_W}}}t", f"{{{_M}}}t"):
                parts.append(node.text or "")
            elif node.tag in (f"{{{_W}}}br", f"{{{_W}}}cr"):
                parts.append("\n")
            elif node.tag == f"{{{_W}}}tab":
                parts.append("\t")
        texts.append("".join(parts))
    worded = [t for t in texts if t.strip()]
    count = lambda name: sum(1 for _ in root.iter(f"{{{_W}}}{name}"))
    return True, len(worded), count("tbl"), count("drawing"), " ".join(" ".join(worded).split())


@F.pandas_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("paragraphs", T.LongType()), T.StructField("tables", T.LongType()), T.StructField("drawings", T.LongType()), T.StructField("projection", T.StringType())]))
def held(content: pd.Series) -> pd.DataFrame:
    """What a Word package holds: whether it can be read, paragraphs with text, tables, drawings, and its text with white space
    collapsed."""
    return pd.DataFrame([_held(None if x is None else bytes(x)) for x in content], columns=["valid", "paragraphs", "tables", "drawings", "projection"])


def docx_editability(packages: DataFrame, content: str = "content") -> DataFrame:
    """Add elements, editable_ratio and native_structure_ratio: text and tables can be edited, drawings cannot. 0 without
    anything."""
    rows = packages.withColumn("_h", held(content)).select("*", "_h.*").drop("_h")
    n = F.col("paragraphs") + F.col("tables") + F.col("drawings")
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    return rows.withColumns({"elements": n, "editable_ratio": share(F.col("paragraphs") + F.col("tables")), "native_structure_ratio": share(F.col("tables"))})


def comparison_page(title: Column, score: Column, reference: Column, candidate: Column) -> Column:
    """A page of its own that shows two pictures (PNG bytes) side by side with their score; a missing one is said to be."""
    safe = title
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    picture = lambda c, name: F.coalesce(F.concat(F.lit('<img src="data:image/png;base64,'), F.regexp_replace(F.base64(c), r"\s", ""), F.lit(f'" alt="{name}">')), F.lit(f"<p>no {name}</p>"))
    return F.concat(F.lit("<!doctype html><title>"), safe, F.lit("</title><h1>"), safe, F.lit("</h1><p>score "), F.format_string("%.6f", score), F.lit("</p>"), picture(reference, "reference"), picture(candidate, "candidate"))
