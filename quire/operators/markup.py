"""Markdown and HTML to rows, as Arrow functions where a text has to be read in order."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?-->", re.DOTALL)
_SPAN = re.compile(r"(colspan|rowspan)\s*=\s*[\"']?\s*(\d+)", re.IGNORECASE)


def table_cells(source: str) -> list[tuple[int, int, int, int, str]]:
    """Cells (row, column, row_span, column_span, text) of a text's first table; nested tables count as their text.
    A cell goes to the first free column of its row; spans hold columns in later rows too, up to 100."""
    out: list[tuple[int, int, int, int, str]] = []
    held: set[tuple[int, int]] = set()
    depth = mute = at = 0
    row, cell, any_cell = -1, None, False
    open_row = False

    def close():
        nonlocal cell, any_cell
        if cell is None:
            return
        column = 0
        while (row, column) in held:
            column += 1
        down, across, parts = cell
        held.update((row + i, column + j) for i in range(down) for j in range(across))
        out.append((row, column, down, across, html.unescape("".join(parts)).strip()))
        cell, any_cell = None, True

    for m in _TAG.finditer(source):
        if cell is not None and not mute:
            cell[2].append(source[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        end, tag = bool(m.group(1)), m.group(2).lower()
        if tag == "table":
            if end and depth == 1:
                close()
                break
            depth += -1 if end and depth else 0 if end else 1
        elif tag in ("script", "style", "template"):
            mute = max(0, mute - 1) if end else mute + 1
        elif depth == 1 and tag == "tr":
            close()
            if end:
                open_row = False
            else:
                if row < 0 or any_cell:
                    row += 1
                open_row, any_cell = True, False
        elif depth == 1 and tag in ("td", "th") and open_row:
            close()
            if not end:
                found = {k.lower(): min(100, max(1, int(v))) for k, v in _SPAN.findall(m.group(3))}
                cell = (found.get("rowspan", 1), found.get("colspan", 1), [])
        elif tag == "br" and cell is not None:
            cell[2].append("\n")
    return out


def html_table_cells(pages: DataFrame, key: str, source: str) -> DataFrame:
    """table_cells() of each row: key, row, column, row_span, column_span, text."""
    kind = dict(pages.dtypes)[key]

    def run(frames):
        for pdf in frames:
            rows = [(k, *c) for k, s in zip(pdf[key], pdf[source], strict=True) if s for c in table_cells(s)]
            yield pd.DataFrame(rows, columns=[key, "row", "column", "row_span", "column_span", "text"])

    return pages.select(key, source).where(F.col(source).rlike("(?i)<table")).mapInPandas(run, f"{key} {kind}, row int, column int, row_span int, column_span int, text string")


_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*$")
_ITEM = re.compile(r"(?:[-*+]|\d{1,9}[.)]|\(\d+\))\s+")
_RULE = re.compile(r"([-*_])(?:\s*\1){2,}$")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)$")
_OPTION = re.compile(r"[A-Da-d][.)]\s+")
_DISPLAY = re.compile(r"\$\$(.+?)\$\$", re.DOTALL)


def markdown_blocks(text: str) -> list[tuple[str, str, int | None]]:
    """Blocks (kind, text, heading level) of a Markdown text in order: code, heading, image, table, rule, list_item, option,
    equation and paragraph. Lines of a paragraph are joined; a list item ends at the next marker or at a line that is
    not indented beyond it."""
    out: list[tuple[str, str, int | None]] = []
    held: list[str] = []
    fence: list[str] | None = None
    table: list[str] | None = None
    indent = None

    def flush():
        nonlocal indent
        indent = None
        if held:
            whole = " ".join(held)
            held.clear()
            last = 0
            for m in [*_DISPLAY.finditer(whole), None]:
                plain = html.unescape(whole[last : m.start() if m else None]).strip()
                if plain:
                    kind = "option" if _OPTION.match(plain) else "list_item" if _ITEM.match(plain) else "paragraph"
                    out.append((kind, plain, None))
                if m:
                    out.append(("equation", m.group(1).strip(), None))
                    last = m.end()

    for line in text.split("\n"):
        bare = line.strip()
        if fence is not None:
            if bare.startswith("```"):
                out.append(("code", "\n".join(fence), None))
                fence = None
            else:
                fence.append(line)
            continue
        if table is not None:
            table.append(bare)
        elif bare.startswith("```"):
            flush()
            fence = []
            continue
        elif bare.lower().startswith("<table"):
            flush()
            table = [bare]
        if table is not None:
            if "</table>" in bare.lower():
                out.append(("table", "\n".join(table), None))
                table = None
            continue
        if not bare:
            flush()
        elif _RULE.match(bare):
            flush()
            out.append(("rule", "", None))
        elif m := _HEADING.match(bare):
            flush()
            out.append(("heading", html.unescape(m.group(2)).strip(), len(m.group(1))))
        elif m := _IMAGE.match(bare):
            flush()
            out.append(("image", m.group(1), None))
        else:
            own = len(line) - len(line.lstrip())
            if _ITEM.match(bare):
                flush()
                indent = own
            elif indent is not None and own <= indent:
                flush()
            held.append(bare)
    flush()
    if fence:
        out.append(("code", "\n".join(fence), None))
    if table:
        out.append(("table", "\n".join(table), None))
    return out


def parse_markdown(docs: DataFrame, key: str, source: str) -> DataFrame:
    """markdown_blocks() of each row: key, index, kind, text, level. A null text has no blocks."""
    kind = dict(docs.dtypes)[key]

    def run(frames):
        for pdf in frames:
            rows = [(k, i, *b) for k, s in zip(pdf[key], pdf[source], strict=True) if s for i, b in enumerate(markdown_blocks(s))]
            out = pd.DataFrame(rows, columns=[key, "index", "kind", "text", "level"])
            out["level"] = out["level"].astype("Int64")
            yield out

    return docs.select(key, source).mapInPandas(run, f"{key} {kind}, index int, kind string, text string, level long")


def html_blocks(pages: DataFrame, key: str, source: str) -> DataFrame:
    """Blocks of a page by tag: key, ordinal, tag and text (tags within dropped) of headings, paragraphs and list items."""
    found = F.regexp_extract_all(source, F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)\s*>"), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("ordinal", "_b"))
    text = F.trim(F.regexp_replace(F.regexp_replace("_b", r"<[^>]*>", ""), r"\s+", " "))
    return rows.select(key, "ordinal", F.lower(F.regexp_extract("_b", r"^<([a-zA-Z0-9]+)", 1)).alias("tag"), text.alias("text"))
