"""Tables and form fields of saved results: cells with their places and spans, fields with their names and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

CELLS = ["doc_id", "table_id", "row", "column", "row_span", "column_span", "text", "is_header"]
_BLOCK = "array<struct<Id:string,BlockType:string,Text:string,RowIndex:int,ColumnIndex:int,RowSpan:int,ColumnSpan:int,EntityTypes:array<string>,SelectionStatus:string,Relationships:array<struct<Type:string,Ids:array<string>>>>>"


def _whole(paths: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object("payload", p) for p in paths], F.col("payload"))


def _in_graph(payloads: DataFrame, rows) -> DataFrame:
    """rows(blocks, words) of each payload's block graph: lists of structs. Words are an index of the blocks with texts."""
    word = lambda b: _word(b).isNotNull()
    blocks = graph.parsed(F.col("payload"), "Blocks", _BLOCK)
    return payloads.select("doc_id", F.inline(graph.once(blocks, lambda b: graph.indexed(b, lambda words: rows(b, words), word))))


def _word(b: Column) -> Column:
    """A block's text; a selected box reads as a cross, another as nothing."""
    return F.when(b["BlockType"] == "SELECTION_ELEMENT", F.when(b["SelectionStatus"] == "SELECTED", F.lit("☒"))).otherwise(b["Text"])


def textract_cells(payloads: DataFrame) -> DataFrame:
    """Cells of block graphs: TABLE blocks lead to CELL blocks, and these to words. Rows and columns count from 0."""

    def cell(c: Column, table: Column, words: Column) -> Column:
        text = F.coalesce(graph.words(F.array(c), words, _word), F.lit(""))
        header = F.coalesce(F.array_contains(c["EntityTypes"], "COLUMN_HEADER"), F.lit(False))
        values = (table, c["RowIndex"] - 1, c["ColumnIndex"] - 1, F.coalesce(c["RowSpan"], F.lit(1)), F.coalesce(c["ColumnSpan"], F.lit(1)), text, header)
        return F.struct(*[v.alias(n) for n, v in zip(CELLS[1:], values, strict=True)])

    def of_table(t: Column, cells: Column, words: Column) -> Column:
        named = graph.joined(F.transform(graph.kids(F.array(t)), lambda x: graph.found(cells, x["Id"])))
        return F.transform(named, lambda c: cell(c, t["Id"], words))

    def rows(blocks: Column, words: Column) -> Column:
        tables = F.filter(blocks, lambda b: (b["BlockType"] == "TABLE") & b["Id"].isNotNull())
        return graph.indexed(blocks, lambda cells: graph.joined(F.transform(tables, lambda t: of_table(t, cells, words))), lambda b: b["BlockType"] == "CELL")

    return _in_graph(payloads, rows)


def textract_fields(payloads: DataFrame) -> DataFrame:
    """Form fields of block graphs: KEY blocks with their words and those of the VALUE blocks they lead to."""

    def field(b: Column, values: Column, words: Column) -> Column:
        text = lambda x: graph.words(graph.found(values, x["Id"]), words, _word)
        parts = F.transform(graph.kids(F.array(b), "VALUE"), lambda x: F.struct(x["k"].alias("k"), text(x).alias("text")))
        value = F.array_join(F.transform(F.sort_array(parts), lambda x: x["text"]), " ")
        name = F.coalesce(graph.words(F.array(b), words, _word), F.lit(""))
        return F.struct(b["Id"].alias("field_id"), name.alias("name"), F.coalesce(value, F.lit("")).alias("value"))

    def rows(blocks: Column, words: Column) -> Column:
        keys = F.filter(blocks, lambda b: (b["BlockType"] == "KEY_VALUE_SET") & F.array_contains(b["EntityTypes"], "KEY"))
        leads = lambda b: F.size(b["Relationships"]) > 0
        return graph.indexed(blocks, lambda values: F.transform(keys, lambda b: field(b, values, words)), leads)

    return _in_graph(payloads, rows)


def azure_cells(payloads: DataFrame) -> DataFrame:
    """Cells of a layout result's tables; header kinds tell headers."""
    shape = "array<struct<cells:array<struct<rowIndex:int,columnIndex:int,rowSpan:int,columnSpan:int,content:string,kind:string>>>>"
    other = F.from_json(F.get_json_object(_whole(["$.analyzeResult", "$.result.analyzeResult"]), "$.tables"), shape)
    tables = payloads.select("doc_id", F.posexplode(F.coalesce(graph.parsed(F.col("payload"), "analyzeResult", f"struct<tables:{shape}>")["tables"], other)).alias("t", "g"))
    rows = tables.select("doc_id", F.concat(F.lit("t"), "t").alias("table_id"), F.explode("g.cells").alias("c"))
    return rows.select("doc_id", "table_id", F.col("c.rowIndex").alias("row"), F.col("c.columnIndex").alias("column"), F.coalesce("c.rowSpan", F.lit(1)).alias("row_span"), F.coalesce("c.columnSpan", F.lit(1)).alias("column_span"), F.coalesce("c.content", F.lit("")).alias("text"), F.coalesce(F.col("c.kind").isin("columnHeader", "rowHeader"), F.lit(False)).alias("is_header"))


_LAYOUT = "layout:struct<textAnchor:struct<content:string,textSegments:array<struct<startIndex:string,endIndex:string>>>>"


def _anchored(whole: Column, layout: Column) -> Column:
    """An anchor's own text, else its slices [start, end) of the whole text, trimmed."""
    start = lambda s: F.coalesce(s["startIndex"].try_cast("int"), F.lit(0))
    cut = F.array_join(F.transform(layout["textAnchor"]["textSegments"], lambda s: F.substring(whole, start(s) + 1, s["endIndex"].try_cast("int") - start(s))), "")
    return F.regexp_replace(F.coalesce(layout["textAnchor"]["content"], cut, F.lit("")), r"^\s+|\s+$", "")


def _documents(payloads: DataFrame, shape: str) -> DataFrame:
    """doc_id and d, a processed document; the array keeps what takes it apart from reading it again for each part."""
    whole = F.coalesce(graph.parsed(F.col("payload"), "document", shape), F.from_json("payload", shape))
    return payloads.select("doc_id", F.explode(F.array(whole)).alias("d"))


def google_cells(payloads: DataFrame) -> DataFrame:
    """Cells of a processed document's tables, header rows first. A cell takes the place after those before it in its row;
    spans over rows are kept as they are said."""
    row = f"array<struct<cells:array<struct<rowSpan:int,colSpan:int,{_LAYOUT}>>>>"
    shape = f"struct<text:string,pages:array<struct<tables:array<struct<headerRows:{row},bodyRows:{row}>>>>>"
    pages = _documents(payloads, shape).select("doc_id", F.col("d.text").alias("whole"), F.posexplode("d.pages").alias("p", "g"))
    tables = pages.select("doc_id", "whole", "p", F.posexplode("g.tables").alias("t", "t_"))
    heads = F.coalesce(F.size("t_.headerRows"), F.lit(0))
    both = F.concat(F.coalesce("t_.headerRows", F.array().cast(row)), F.coalesce("t_.bodyRows", F.array().cast(row)))
    rows = tables.select("doc_id", "whole", "p", "t", F.greatest(heads, F.lit(0)).alias("heads"), F.posexplode(both).alias("r", "row_"))
    cells = rows.select("*", F.posexplode("row_.cells").alias("k", "c"))
    across = F.aggregate(F.slice("row_.cells", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + F.coalesce(x["colSpan"], F.lit(1)))
    return cells.select("doc_id", F.concat(F.lit("p"), "p", F.lit("t"), "t").alias("table_id"), F.col("r").alias("row"), across.alias("column"), F.coalesce("c.rowSpan", F.lit(1)).alias("row_span"), F.coalesce("c.colSpan", F.lit(1)).alias("column_span"), _anchored(F.col("whole"), F.col("c.layout")).alias("text"), (F.col("r") < F.col("heads")).alias("is_header"))


def google_fields(payloads: DataFrame) -> DataFrame:
    """Form fields of a processed document: the anchored texts of their names (without a last colon) and values."""
    anchor = _LAYOUT.removeprefix("layout:")
    shape = f"struct<text:string,pages:array<struct<formFields:array<struct<fieldName:{anchor},fieldValue:{anchor}>>>>>"
    pages = _documents(payloads, shape).select("doc_id", F.col("d.text").alias("whole"), F.posexplode("d.pages").alias("p", "g"))
    rows = pages.select("doc_id", "whole", "p", F.posexplode("g.formFields").alias("k", "f"))
    name = F.regexp_replace(_anchored(F.col("whole"), F.col("f.fieldName")), r"\s*:$", "")
    return rows.select("doc_id", F.concat(F.lit("p"), "p", F.lit("f"), "k").alias("field_id"), name.alias("name"), _anchored(F.col("whole"), F.col("f.fieldValue")).alias("value"))


def cells_markdown(cells: DataFrame) -> DataFrame:
    """One Markdown table a table: the rows in order, the first as header, empty places where spans cover or cells lack."""
    width = cells.groupBy("doc_id", "table_id").agg(F.max(F.col("column") + F.col("column_span")).alias("_w"), F.max(F.col("row") + F.col("row_span")).alias("_h"), F.collect_list(F.struct("row", "column", "text")).alias("_c"))
    plain = lambda x: F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    at = lambda r, c: F.coalesce(F.array_min(F.transform(F.filter("_c", lambda x: (x["row"] == r) & (x["column"] == c)), lambda x: plain(x["text"]))), F.lit(""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda c: at(r, c)), " | "), F.lit(" |"))
    lines = F.transform(F.sequence(F.lit(0), F.col("_h") - 1), line)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda c: F.lit("---")), " | "), F.lit(" |"))
    text = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.col("_h"))), "\n")
    return width.select("doc_id", "table_id", text.alias("markdown"))
