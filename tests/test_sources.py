"""Readers, writers and packages, with awkward rows."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire import plugins
from quire.fixtures import observations
from quire.operators import evidence, frames, revision, scoring, topology
from quire.sources import payloads, sniff, tables, word

SF = "/root/testdata/sf0.001"


def test_word_packages_hold_what_was_written(spark):
    rows = [(1, 1, 1, "title", "A <b> & c"), (1, 1, 2, "paragraph", "two\nlines\x07"), (1, 2, 1, "table", "a\tb\nc\td"), (1, 2, 2, "text", None), (2, 1, 1, "text", "é中"), (None, 1, 1, "text", "x")]
    made = word.documents_docx(spark.createDataFrame(rows, "doc long, page int, reading_order int, kind string, text string"), "doc", "page")
    got = {r.doc: r for r in word.docx_editability(made).collect()}
    assert set(got) == {1, 2}
    assert got[1].valid and (got[1].tables, got[1].drawings) == (1, 0)
    assert got[1].projection == "A <b> & c two lines a b c d" and got[2].projection == "é中"
    assert got[1].editable_ratio == 1.0 and 0 < got[1].native_structure_ratio < 1
    assert word.package([(1, "text", "x")]) == word.package([(1, "text", "x")])
    bad = spark.createDataFrame([(bytearray(b"no zip"),), (None,), (bytearray(b""),)], "content binary")
    assert {(r.valid, r.elements, r.editable_ratio) for r in word.docx_editability(bad).collect()} == {(False, 0, 0.0)}
    assert zipfile.ZipFile(io.BytesIO(word.package([]))).namelist()[-1] == "word/document.xml"


def test_comparison_pages_are_whole(spark):
    rows = spark.createDataFrame([("a<b", 0.5, bytearray(b"png"), None)], "t string, s double, a binary, b binary")
    page = rows.select(word.comparison_page(F.col("t"), F.col("s"), F.col("a"), F.col("b")).alias("h")).first().h
    assert "a&lt;b" in page and "base64,cG5n" in page and "no candidate" in page and "0.500000" in page


def test_readers_and_writers_have_names(spark, tmp_path):
    registry = plugins.Registry(a=len)
    registry.add("B-c", max)
    assert registry.names() == ["a", "b_c"] and registry.get("b-C") is max
    with pytest.raises(ValueError):
        registry.add("a", min)
    registry.add("a", min, replace=True)
    with pytest.raises(KeyError):
        registry.get("z")
    rows = spark.createDataFrame([(1, '{"natural_text":"x"}')], "doc_id long, payload string")
    assert plugins.read(rows, "OlmOCR").first().text == "x"
    elements = observations(spark, SF).where("page_id < 40").select(F.lit(1).alias("doc"), "page_id", F.col("element_id").alias("reading_order"), "kind", "text", F.lit(None).cast("int").alias("level"), "x0", "y0", "x1", "y1")
    for form in plugins.WRITERS.names():
        plugins.export(elements, f"{tmp_path}/{form}", form, "doc", "page_id")
        assert spark.read.parquet(f"{tmp_path}/{form}").count() >= 1


def test_images_are_read_by_their_headers(spark, tmp_path):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 300, 77, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 513, 9) + b"\x00\x00\x00")
    (tmp_path / "c.bin").write_bytes(b"what")
    got = {r.path[-5:]: (r.format, r.width, r.height) for r in payloads.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 300, 77), "b.gif": ("gif", 513, 9), "c.bin": (None, None, None)}


def test_boxes_and_texts_of_odd_payloads(spark):
    rows = [(None,), ("",), ("[]",), ('{"bbox":{"left":1,"top":2,"right":3,"bottom":4}}',), ('{"bbox":[1,2,3]}',), ("[[1,2],[5,0],[3,9]]",), ('{"x":1,"y":2,"width":null,"height":3}',), ("not json",)]
    got = [r.b for r in spark.createDataFrame(rows, "p string").select(payloads.coerced_box(F.col("p")).alias("b")).collect()]
    assert [None if b is None else tuple(b) for b in got] == [None, None, None, (1, 2, 3, 4), None, (1, 0, 5, 9), None, None]
    said = spark.createDataFrame([('{"text":"a"}',), ('{"lines":["a","a","b"]}',), ('{"spans":["a","a"]}',), ("{}",), (None,)], "p string")
    assert [r.t for r in said.select(payloads.stated_text(F.col("p")).alias("t")).collect()] == ["a", "a\nb", "aa", None, None]


def test_results_without_tables_or_fields_give_no_rows(spark):
    rows = spark.createDataFrame([(1, "{}"), (2, None), (3, '{"Blocks":[]}'), (4, "no json"), (5, '{"document":{"text":"x","pages":[]}}')], "doc_id long, payload string")
    for f in (tables.textract_cells, tables.textract_fields, tables.azure_cells, tables.google_cells, tables.google_fields):
        assert f(rows).count() == 0
        assert f(rows.limit(0)).count() == 0


def test_frames_of_empty_and_unknown_pages(spark):
    shape = "page_id long, source string, source_type string, width double, height double, confidence double, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, "a", "scanned", 0.0, 0.0, None, 0.0, 0.0, 1.0, 1.0), (1, "b", "native", 100.0, 200.0, None, 10.0, 10.0, 20.0, 20.0), (1, "c", "image", 200.0, 400.0, 0.9, 20.0, 20.0, 40.0, 40.0)]
    got = {r.source: r for r in frames.rescaled(spark.createDataFrame(rows, shape), "page_id").collect()}
    assert not got["a"].rescaled and not got["b"].rescaled and got["c"].rescaled
    assert (got["c"].x0, got["c"].y1, got["c"].width) == (10.0, 20.0, 100.0)
    assert frames.rescaled(spark.createDataFrame([], shape), "page_id").count() == 0


def test_mixed_frames_fuse_in_any_order(spark):
    """Points against pixels: without one frame the two readings would never meet."""
    from quire.plans import fusion

    shape = "page_id long, element_id long, source string, source_type string, width double, height double, kind string, x0 double, y0 double, x1 double, y1 double, confidence double, text string"
    points = [(1, i, "pdf", "native", 600.0, 800.0, "text", 50.0, 40.0 * i, 550.0, 40.0 * i + 30, 0.9, f"line number {i}") for i in range(5)]
    pixels = [(1, 100 + i, "ocr", "scanned", 1200.0, 1600.0, "text", 100.0, 80.0 * i, 1100.0, 80.0 * i + 60, 0.8, f"Line  number {i}") for i in range(5)]
    results = []
    for rows in (points + pixels, (points + pixels)[::-1]):
        framed = frames.rescaled(spark.createDataFrame(rows, shape), "page_id")
        results.append(sorted(map(tuple, fusion.fuse(framed).collect())))
    assert results[0] == results[1] and len(results[0]) == 5
    apart = fusion.fuse(spark.createDataFrame(points + pixels, shape)).count()
    assert apart > 5


def test_empty_tables_give_no_rows(spark):
    rows = observations(spark, SF).limit(0).withColumns({"role": F.lit(None).cast("string"), "column": F.lit(0)})
    regions = topology.page_regions(rows, "page_id")
    assert regions.count() == 0 and topology.semantic_edges(regions, "page_id").count() == 0 and topology.precedence_edges(regions, "page_id").count() == 0
    assert evidence.merged_rows(rows, "page_id").count() == 0
    assert frames.page_components(rows.select("page_id", F.col("element_id").alias("a"), F.col("element_id").alias("b")), "page_id").count() == 0
    assert revision.row_gaps(rows.withColumn("block_index", F.lit(1)), ["page_id"], F.lit(1.0)).count() == 0
    assert scoring.page_texts(rows.withColumns({"reading_order": F.lit(None).cast("int"), "position": F.lit(1), "doc": F.lit(1)}), "doc", "page_id").count() == 0


def test_boxes_stated_in_many_ways(spark):
    box = (1.0, 2.0, 5.0, 9.0)
    stated = {
        '{"x0":5,"y0":"9","x1":1,"y1":2}': box,
        '{"x":1,"y":2,"width":4,"height":7}': box,
        '{"bbox":{"left":1,"top":2,"right":5,"bottom":9}}': box,
        '{"coordinates":[1,2,5,2,5,9,1,9]}': box,
        '{"bbox":{"x":1,"y":"2","width":4,"height":7}}': box,
        '{"poly":[[1,9],[5,2],["x",3]]}': box,
        '{"poly":[["1",9],[5,2,8],[3,3],[4,4]]}': box,
        '{"poly":[[1,9],[5,2],[3]]}': None,
        '{"poly":[[1,9],[5,2]]}': None,
        "[5,9,1,2]": box,
        " [ [1,2],[5,9],[2,2]]": box,
        '["1","2","5","9"]': box,
        '{"bbox":[1,2,3],"box":[1,2,5,9]}': box,
        '{"x0":1,"y0":2,"x1":"NaN","y1":9}': None,
        '{"x0":1,"y0":2,"x1":"Infinity","y1":9}': None,
        '{"bbox":null}': None,
        '{"bbox":[]}': None,
        "[1,2,null,4]": None,
        "{}": None,
        "no JSON": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(p,) for p in stated], "payload string")
    got = {r.payload: tuple(r.b) if r.b else None for r in rows.select("payload", payloads.coerced_box(F.col("payload")).alias("b")).collect()}
    assert got == stated


def test_schemas_are_known_by_escaped_names_too(spark):
    said = [("a", '{"natur\\u0061l_text":"t"}'), ("b", '{"natural_text":"t"}'), ("c", "{}"), ("d", None), ("e", "")]
    rows = sniff.normalize(spark.createDataFrame(said, "doc_id string, payload string")).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [("a", "t"), ("b", "t")]


def _graph_rows(spark, *documents):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "doc_id long, payload string")


def test_large_block_graphs_are_read_by_id_without_joins(spark):
    """Beyond a few hundred blocks ids are halved; repeated ids count each; links to nothing give no word."""
    n = 400
    words = [{"Id": f"w{i}", "BlockType": "WORD", "Text": f"t{i}"} for i in range(n)] + [{"Id": "w7", "BlockType": "WORD", "Text": "again"}]
    cells = [{"Id": f"c{i}", "BlockType": "CELL", "RowIndex": i + 1, "ColumnIndex": 1, "Relationships": [{"Type": "CHILD", "Ids": [f"w{i}", "none", f"w{n - 1 - i}"]}]} for i in range(n)]
    table = {"Id": "t", "BlockType": "TABLE", "Relationships": [{"Type": "CHILD", "Ids": [f"c{i}" for i in range(n)] + ["none", None]}]}
    keys = [{"Id": "k", "BlockType": "KEY_VALUE_SET", "EntityTypes": ["KEY"], "Relationships": [{"Type": "CHILD", "Ids": ["w1"]}, {"Type": "VALUE", "Ids": ["v", "none"]}]}, {"Id": "v", "BlockType": "KEY_VALUE_SET", "Relationships": [{"Type": "CHILD", "Ids": ["w7", "w2"]}]}]
    lines = [{"Id": "l", "BlockType": "LINE", "Relationships": [{"Type": "CHILD", "Ids": ["w7", "w399"]}]}, {"Id": "l2", "BlockType": "LINE", "Relationships": []}]
    rows = _graph_rows(spark, {"Blocks": [table, *cells, *words, *keys, *lines]}, {"Blocks": {"Id": "x", "BlockType": "LINE", "Text": "one"}})
    found = tables.textract_cells(rows)
    assert not re.search("Join (Inner|LeftOuter)", found._jdf.queryExecution().optimizedPlan().toString())
    said = {r["row"]: r["text"] for r in found.collect()}
    both = lambda i: "again t7" if i == 7 else f"t{i}"
    assert said == {i: f"{both(i)} {both(n - 1 - i)}" for i in range(n)}
    fields = tables.textract_fields(rows)
    assert not re.search("Join (Inner|LeftOuter)", fields._jdf.queryExecution().optimizedPlan().toString())
    assert [tuple(r) for r in fields.collect()] == [(0, "k", "t1", "again t7 t2")]
    assert sorted((r.element_id, r.text) for r in sniff.normalize(rows).collect()) == [("l", "again t7 t399"), ("l2", None), ("x", "one")]


def test_payloads_are_told_apart_and_read_once(spark):
    """Neither a condition on the schema nor the parsing by schema works out the payloads or the detection again."""
    rows = _graph_rows(spark, {"natural_text": "a"}, {"no": 1})
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan(sniff.normalize(rows)) and not re.search("Join (Inner|LeftOuter)", plan(sniff.normalize(rows)))
    once = plan(sniff.detect(rows)).count("$.ocr_results")
    assert once > 0 and plan(sniff.normalize(rows)).count("$.ocr_results") == plan(sniff.detect(rows).where("provider = 'olmocr'")).count("$.ocr_results") == once
