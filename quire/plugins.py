"""Named readers and writers, which others can add to: a reader turns payloads into elements, a writer elements into texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources import sinks, sniff, word


class Registry:
    """Functions by name. A name is given once, unless it is said to be replaced."""

    def __init__(self, **known: Callable):
        self._known = dict(known)

    def add(self, name: str, f: Callable, replace: bool = False) -> None:
        key = name.strip().lower().replace("-", "_")
        if not key:
            raise ValueError("a name must not be empty")
        if key in self._known and not replace:
            raise ValueError(f"{key} is already there")
        self._known[key] = f

    def get(self, name: str) -> Callable:
        key = name.strip().lower().replace("-", "_")
        if key not in self._known:
            raise KeyError(f"no {key} among {', '.join(self.names())}")
        return self._known[key]

    def names(self) -> list[str]:
        return sorted(self._known)


READERS = Registry(
    aws_textract=sniff.textract, azure_document_intelligence=sniff.azure_paragraphs, google_document_ai=sniff.google_paragraphs, mathpix=sniff.contour_lines, mineru=sniff.content_lists, paddleocr=sniff.recognition_arrays,
    mistral_ocr=lambda rows: sniff.page_texts(rows, "$.pages", "markdown"), olmocr=sniff.natural_texts, canonical=sniff.canonical,
)
WRITERS = Registry(json=sinks.documents_json, md=sinks.markdown, html=sinks.absolute_html, docx=word.documents_docx)


def read(payloads: DataFrame, provider: str) -> DataFrame:
    """Elements of payloads (doc_id, payload) by a named reader."""
    return READERS.get(provider)(payloads)


def export(elements: DataFrame, folder: str, form: str, document: str, page: str) -> None:
    """Write elements by a named writer as Parquet: a row a document (or page) with its key and text or bytes. Spark's commit
    leaves nothing half-written."""
    WRITERS.get(form)(elements, document, page).withColumn("format", F.lit(form)).write.mode("overwrite").parquet(folder)
