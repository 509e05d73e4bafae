"""Alignment, columns, plans, rasters and sources on hand-written rows."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest

from quire.operators import alignment, columns, planning, raster
from quire.sources import manifests, sniff

UNITS = "doc_id string, source string, page int, position int, kind string, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
BLOCKS = "doc_id string, block_index int, kind string, text string"


def corpus(spark):
    texts = ["Annual report", "The first para-", "graph goes here.", "Second paragraph text", "a table of numbers", "closing words"]
    units = [("d", s, 1 + i // 4, i, "title" if i == 0 else "text", x, 0.9, 0.0, 10.0 * i, 50.0 + k, 10.0 * i + 8) for k, s in enumerate(("s", "t")) for i, x in enumerate(texts)]
    blocks = [("d", 0, "heading", "Annual Report"), ("d", 1, "paragraph", "The first para- graph goes here."), ("d", 2, "paragraph", "Second paragraph text"), ("d", 3, "paragraph", "nothing like it at all"), ("d", 4, "paragraph", "closing words")]
    return spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(units, UNITS)


def test_blocks_find_their_units(spark):
    blocks, units = corpus(spark)
    found = alignment.candidates(blocks, units)
    chosen = alignment.align(found)
    got = {(r.source, r.block_index): (r.first, r.end) for r in chosen.collect()}
    want = {0: (0, 1), 1: (1, 3), 2: (3, 4), 4: (5, 6)}
    assert got == {(s, b): v for s in ("s", "t") for b, v in want.items()}
    boxes = {r.block_index: (r.page, r.sources, r.y0, r.y1, r.x1) for r in alignment.consensus_boxes(chosen, units).collect()}
    assert boxes[1] == (1, 2, 10.0, 28.0, 50.0)
    assert [tuple(r) for r in alignment.rejected(blocks, found, chosen).collect()] == [("d", 3, "no candidate")]
    exact = {(r.source, r.block_index, r.first) for r in alignment.exact_anchors(blocks, units).collect()}
    assert exact == {(s, b, f) for s in ("s", "t") for b, f in ((0, 0), (1, 1), (2, 3), (4, 5))}


def test_the_chain_is_the_best():
    class R:
        def __init__(self, *x):
            self.block_index, self.first, self.end, self.score = x

    rng = random.Random(6)
    for _ in range(80):
        rows = [R(rng.randrange(4), f := rng.randrange(8), f + rng.randrange(1, 4), round(rng.uniform(0.6, 1), 3)) for _ in range(7)]
        best = 0.0
        for k in range(1, 5):
            for pick in itertools.combinations(sorted(rows, key=lambda r: r.block_index), k):
                if all(a.block_index < b.block_index and a.end <= b.first for a, b in itertools.pairwise(pick)):
                    best = max(best, sum(r.score for r in pick))
        got = alignment._choose(rows)
        assert all(a.block_index < b.block_index and a.end <= b.first for a, b in itertools.pairwise(got))
        assert sum(r.score for r in got) == pytest.approx(best)


def test_columns(spark):
    rows = [(1, "head", "title", 0.0, 0.0, 100.0, 8.0)] + [(1, f"{c}{i}", "text", 35.0 * c, 10.0 + 20 * i, 35.0 * c + 25, 25.0 + 20 * i) for c in range(3) for i in range(3)]
    rows += [(2, f"p{i}", "text", 0.0, 10.0 * i, 90.0, 10.0 * i + 8) for i in range(6)]
    got = {(r.page_id, r.element_id): r.column for r in columns.page_columns(spark.createDataFrame(rows, "page_id int, element_id string, kind string, x0 double, y0 double, x1 double, y1 double"), 100.0).collect()}
    assert got[1, "head"] == -1
    assert all(got[1, f"{c}{i}"] == c for c in range(3) for i in range(3))
    assert all(got[2, f"p{i}"] == 0 for i in range(6))


def test_page_plans(spark):
    assert planning.segment([1, 1, 1, 1], 2) == [0, 0, 1, 1]
    assert planning.segment([1, 1, 1, 1], 2, fixed={0: 0, 1: 1}) == [0, 1, 1, 1]
    assert planning.segment([4, 1, 1, 1, 1], 2) == [0, 1, 1, 1, 1]
    assert planning.segment([], 2) == []
    with pytest.raises(ValueError):
        planning.segment([1, 1], 2, fixed={0: 1, 1: 0})
    blocks = spark.createDataFrame([("d", i, 1.0, 1 if i == 2 else None) for i in range(4)], "doc_id string, block_index int, weight double, page int")
    got = planning.plan_pages(blocks, spark.createDataFrame([("d", 2)], "doc_id string, pages int")).orderBy("block_index").collect()
    assert [r.page for r in got] == [0, 0, 1, 1]


def test_bounded_search():
    climb = planning.bounded_search(9, lambda x: (abs(x - 4), x), lambda x: [x + 1, x - 1], passes=20)
    assert (climb.best, climb.ended) == (4, "converged")
    assert planning.bounded_search(9, lambda x: (x,), lambda x: [x - 1], passes=3).ended == "passes"
    assert planning.bounded_search(9, lambda x: (x,), lambda x: [x - 1], passes=50, budget=5).ended == "budget"


def test_rasters(spark):
    page = np.full((60, 80), 255, np.uint8)
    page[20:24, 10:60] = 0
    page[40:50, 30:34] = 0
    same, blank, moved = raster.compare(page, page), raster.compare(page, np.full_like(page, 255)), raster.compare(page, np.roll(page, 1, 1))
    assert same["visual_score"] == pytest.approx(1.0)
    assert blank["visual_score"] < 0.02 < moved["visual_score"] < 1.0001 and moved["ink_f1"] == pytest.approx(1.0)
    assert raster.compare(page, page[:30])["dimensions"] == 0.75
    assert raster.connected(page == 0) == [(10, 20, 60, 24, 200), (30, 40, 34, 50, 40)]
    u = np.zeros((5, 5), bool)
    u[:, 0] = u[:, 4] = u[4, :] = True
    assert raster.connected(u) == [(0, 0, 5, 5, 13)]
    rows = spark.createDataFrame([("a", page.tobytes(), 80, page.tobytes(), 80), ("b", page.tobytes(), 80, None, None)], "k string, reference binary, r_width int, candidate binary, c_width int")
    assert {r.k: round(r.visual_score, 6) for r in raster.visual_metrics(rows, ["k"]).collect()} == {"a": 1.0, "b": 0.0}


def test_more_saved_results(spark):
    azure = {"analyzeResult": {"pages": [{"pageNumber": 1, "words": [{"confidence": 0.8, "span": {"offset": 0, "length": 5}}, {"confidence": 0.6, "span": {"offset": 6, "length": 5}}, {"confidence": 0.1, "span": {"offset": 11, "length": 2}}]}], "paragraphs": [{"content": "Hello world", "role": "sectionHeading", "spans": [{"offset": 0, "length": 11}], "boundingRegions": [{"pageNumber": 2, "polygon": [1, 2, 5, 2, 5, 4, 1, 4]}]}]}}
    google = {"document": {"text": "Hi there", "pages": [{"pageNumber": 1, "dimension": {"width": 100, "height": 200}, "layout": {}, "paragraphs": [{"layout": {"confidence": 0.7, "textAnchor": {"textSegments": [{"endIndex": "3"}, {"startIndex": "3", "endIndex": "8"}]}, "boundingPoly": {"normalizedVertices": [{"x": 0.1, "y": 0.1}, {"x": 0.5, "y": 0.2}]}}}]}]}}
    mathpix = {"pages": [{"page": 1, "lines": [{"id": "z", "type": "section_header", "text": "T", "cnt": [[1, 2], [3, 9]]}]}]}
    mineru = {"pages": [{"content_list": [{"page_idx": 1, "type": "text", "text": "body", "bbox": [0, 1, 2, 3]}]}]}
    canonical = {"schema_version": "0.1", "id": "q", "pages": [{"id": "p", "number": 3, "width": 1, "height": 1, "elements": [{"id": "e", "type": "title", "text": "C", "bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}}]}]}
    bodies = [azure, google, mathpix, mineru, {"natural_text": "N"}, canonical]
    got = {r.doc_id: r for r in sniff.normalize(spark.createDataFrame([(str(i), json.dumps(b)) for i, b in enumerate(bodies)], "doc_id string, payload string")).collect()}
    assert (got["0"].kind, got["0"].page_number, got["0"].x0, got["0"].y1, round(got["0"].confidence, 6)) == ("heading", 2, 1.0, 4.0, 0.7)
    assert (got["1"].text, got["1"].x1, got["1"].y1) == ("Hi there", 50.0, 40.0)
    assert (got["2"].element_id, got["2"].x1, got["2"].y1) == ("z", 3.0, 9.0)
    assert (got["3"].page_number, got["3"].text) == (2, "body")
    assert (got["4"].text, got["5"].page_number, got["5"].kind) == ("N", 3, "title")


def test_manifests(spark, tmp_path):
    body = {"schema_version": "1", "seed": 7, "extraction": {"mode": "fast", "lang": "en"}, "cases": [{"id": "a", "original_layout": "x.pdf", "extraction": {"mode": "best"}, "tags": {"languages": ["en", "fr"], "scripts": "latin"}}, {"id": "a", "reviewed_markdown": "y.md"}, {"id": "c"}]}
    (tmp_path / "m.json").write_text(json.dumps(body))
    rows = manifests.cases(spark, f"{tmp_path}/m.json")
    first = rows.orderBy("case_index").first()
    assert first.extraction == {"mode": "best", "lang": "en"} and first.tags == {"languages": ["en", "fr"], "scripts": ["latin"]}
    assert {(r.case_index, r.fault) for r in manifests.case_faults(rows).collect()} == {(0, "id is taken"), (1, "id is taken"), (2, "no source")}
    (tmp_path / "s.json").write_text(json.dumps({"seed": 1, "samples": [{"id": "s", "source": "a/b.pdf", "ground_truth": "/abs/c.md"}]}))
    s = manifests.training_samples(spark, f"{tmp_path}/s.json").first()
    assert s.source.endswith(f"{tmp_path}/a/b.pdf") and s.ground_truth == "/abs/c.md"
    pages = [{"layout_dets": [{"category_type": "title", "poly": [1, 2, 5, 2, 5, 4, 1, 4], "text": "t", "order": 1}, {"category_type": "x", "ignore": True}], "page_info": {"page_no": 0, "image_path": "i.png", "page_attribute": {"subset": "table_hard"}}}]
    (tmp_path / "p.json").write_text(json.dumps(pages))
    assert [(r.category, r.x1, r.y1) for r in manifests.annotated_pages(spark, f"{tmp_path}/p.json", "hard").collect()] == [("title", 5.0, 4.0)]
    assert manifests.annotated_pages(spark, f"{tmp_path}/p.json", "default").count() == 0
