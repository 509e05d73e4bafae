"""Rules that the supplied tables do not reach, on hand-written rows."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import ids
from quire.functions import text as t
from quire.operators import benchmarks, consensus, graphs, markup, matching, metrics, routing, sequences
from quire.plans import fusion
from quire.sources import sinks, sniff
from quire.streaming import ingest


def one(spark, expr, **columns):
    return spark.createDataFrame([Row(**columns)]).select(expr.alias("x")).first().x


def test_keys_fold_composition_and_case(spark):
    got = spark.createDataFrame([("é  A",), ("é a",), ("STRASSE",), ("straße",), (None,)], "s string").select(t.folded("s")).collect()
    assert [r[0] for r in got] == ["é a", "é a", "strasse", "strasse", None]


def test_numbers(spark):
    assert one(spark, t.numbers(F.col("s")), s="a $1,000 and -5% x7 3.25 −2 v1.2") == ["1000", "-5%", "3.25", "-2"]


def test_scalars(spark):
    got = [one(spark, t.coerced_confidence(F.col("s")), s=s) for s in ("0.5", "87", "100.5", "-3", "x", "nan")]
    assert got == [0.5, 0.87, 1.0, 0.0, None, None]
    kinds = [one(spark, t.element_type(F.col("s")), s=s) for s in ("Page-Number", "sub title", "doc section", "Picture frame", "zzz", "list")]
    assert kinds == ["page_number", "title", "heading", "image", "text", "list_item"]
    assert [one(spark, t.slug(F.col("s")), s=s) for s in ("..a b/c..", "###")] == ["a-b-c", "item"]
    assert one(spark, t.math_count(F.col("s")), s="cost $5 and $10, but $x+1$ and $y$") == 2
    assert one(spark, t.redacted(F.col("s")), s="token=abc /home/u/x/file.pdf") == "token=[redacted] file.pdf"
    assert one(spark, t.xml_safe(F.col("s")), s="a\x01b\tc") == "ab\tc"


def test_geometry(spark):
    a, b = [F.lit(float(x)) for x in (0, 0, 2, 2)], [F.lit(float(x)) for x in (1, 1, 3, 3)]
    touch, flat = [F.lit(float(x)) for x in (2, 0, 4, 2)], [F.lit(1.0)] * 4
    row = spark.range(1).select(g.iou(a, b), g.iou(a, touch), g.iou(flat, flat), g.iou(flat, flat, 1.0), g.agreement(a, b), g.horizontal_overlap(a, b), g.corner_distance(a, b)).first()
    assert [round(x, 6) for x in row] == [round(1 / 7, 6), 0, 0, 1, 0.25, 0.5, 4]


def test_split_is_stable_and_stated_ones_win(spark):
    assert one(spark, ids.split_of(F.col("g")), g="a") == "train"
    assert one(spark, ids.split_of(F.col("g"), 0, F.col("s")), g="a", s="test") == "test"


def test_fingerprint_ignores_order(spark):
    rows = [(i, str(i % 7)) for i in range(200)]
    a = ids.fingerprint(spark.createDataFrame(rows, "a int, b string"), "a", "b").first()
    random.Random(1).shuffle(rows)
    b = ids.fingerprint(spark.createDataFrame(rows, "a int, b string").repartition(5), "a", "b").first()
    assert a == b and a.n_rows == 200
    assert a != ids.fingerprint(spark.createDataFrame(rows[1:], "a int, b string"), "a", "b").first()


def test_assignment_prefers_more_pairs_then_score():
    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        scores = {(r, c): rng.random() for r in range(n) for c in range(m) if rng.random() < 0.6}
        best = (0, 0.0)
        for k in range(1, min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    if all(p in scores for p in zip(rows, cols, strict=True)):
                        best = max(best, (k, sum(scores[p] for p in zip(rows, cols, strict=True))))
        got = matching.assign(scores)
        assert len(got) == best[0] and abs(sum(scores[p] for p in got) - best[1]) < 1e-9


OBS = "page_id int, element_id string, source string, kind string, x0 double, y0 double, x1 double, y1 double, text string, confidence double"
PAGE = [
    (1, "a1", "a", "title", 10.0, 10.0, 90.0, 20.0, "Annual Report", 0.95),
    (1, "b1", "b", "heading", 11.0, 10.0, 91.0, 20.0, "Annual  report", 0.92),
    (1, "c1", "c", "title", 10.0, 11.0, 90.0, 21.0, "Annual Report", 0.89),
    (1, "a2", "a", "paragraph", 10.0, 40.0, 90.0, 80.0, "Body text of the page", 0.91),
    (1, "b2", "b", "paragraph", 10.0, 41.0, 90.0, 80.0, "Body text of the pagc", 0.94),
    (1, "c2", "c", "unknown", 300.0, 300.0, 320.0, 320.0, None, None),
    (2, "a1", "a", "text", 0.0, 0.0, 5.0, 5.0, None, 0.5),
]


def test_fusion_does_not_depend_on_order(spark):
    seen = set()
    for seed in range(3):
        rows = PAGE[:]
        random.Random(seed).shuffle(rows)
        out = fusion.fuse(spark.createDataFrame(rows, OBS).repartition(3))
        seen.add(tuple(sorted(map(str, out.select("page_id", "reading_order", "kind", "chosen_text", "votes", "sources", F.round("x0", 6), F.round("confidence", 6)).collect()))))
    assert len(seen) == 1
    rows = fusion.fuse(spark.createDataFrame(PAGE, OBS)).orderBy("page_id", "reading_order").collect()
    assert [(r.page_id, r.sources) for r in rows] == [(1, 3), (1, 2), (1, 1), (2, 1)]
    assert rows[0].chosen_text == "Annual Report" and rows[0].kind == "title"
    assert rows[0].confidence == pytest.approx(1 - 0.05 * 0.08 * 0.11)


def test_one_element_of_a_source_per_cluster(spark):
    rows = [(1, f"a{i}", "a", "text", 0.0, 0.0, 10.0, 10.0, "same", 0.9) for i in range(3)] + [(1, f"b{i}", "b", "text", 0.0, 0.0, 10.0, 10.0, "same", 0.9) for i in range(2)]
    got = matching.fuse_pages(spark.createDataFrame(rows, OBS)).collect()
    pairs = {(r.cluster, r.source) for r in got}
    assert len(got) == len(pairs) == 5 and len({r.cluster for r in got}) == 3


def test_spatial_pairs_are_made_once(spark):
    rng = random.Random(2)
    rows = [(1, i, *(lambda x, y: (x, y, x + rng.uniform(0, 150), y + rng.uniform(0, 150)))(rng.uniform(-50, 300), rng.uniform(-50, 300))) for i in range(60)]
    frame = spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.id, r.id2) for r in matching.spatial_pairs(frame, frame, "page").collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3]))
    assert got == want


def test_weighted_median_is_the_lower(spark):
    rows = [(1, 1.0, 1.0), (1, 2.0, 1.0), (2, 1.0, None), (2, 5.0, 0.9)]
    got = {r.k: r.median for r in consensus.weighted_median(spark.createDataFrame(rows, "k int, v double, confidence double"), ["k"], "v").collect()}
    assert got == {1: 1.0, 2: 5.0}


def test_layers_and_cycles(spark):
    edges = [(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "d", None), (2, "x", "y"), (2, "y", "x"), (2, "y", "z")]
    got = {(r.page, r.node): r.layer for r in graphs.topological_layers(spark.createDataFrame(edges, "page int, src string, dst string"), "page").collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (2, "x"): -1, (2, "y"): -1, (2, "z"): -1}
    rows = [(1, "a", "b", 0.9), (1, "b", "c", 0.8), (1, "c", "a", 0.7), (1, "a", "c", 0.6)]
    kept = {(r.src, r.dst) for r in graphs.acyclic(spark.createDataFrame(rows, "page int, src string, dst string, confidence double"), "page").collect()}
    assert kept == {("a", "b"), ("b", "c"), ("a", "c")}


def test_leaf_engines(spark):
    rows = [("o", "e", None, "Ensemble"), ("o", "p", "e", "Paddle"), ("o", "f", "e", "ensemble"), ("o", "q", "f", "olm"), ("s", "k", None, "native")]
    got = {tuple(r) for r in graphs.leaf_engines(spark.createDataFrame(rows, "owner string, id string, parent string, engine string")).collect()}
    assert got == {("o", "paddle"), ("o", "olm"), ("s", "native")}


def test_html_tables():
    source = "<p>x</p><table><tr><th rowspan=2>A</th><td colspan='2'>B &amp; C</td></tr><tr><td>d<br>e</td><td></td></tr></table><table><tr><td>no</td></tr></table>"
    assert markup.table_cells(source) == [(0, 0, 2, 1, "A"), (0, 1, 1, 2, "B & C"), (1, 1, 1, 1, "d\ne"), (1, 2, 1, 1, "")]
    assert markup.table_cells("no table") == []


def test_markdown_blocks():
    source = "# Title #\n\npara one\ncontinues\n\n- item\n  more\n- second\nafter\n\n---\n```\ncode #\n```\n![alt](a.png)\nA. option\n\nx $$y+1$$ z\n<table><tr>\n<td>1</td></tr></table>"
    got = [(k, x) for k, x, _ in markup.markdown_blocks(source)]
    assert got == [("heading", "Title"), ("paragraph", "para one continues"), ("list_item", "- item more"), ("list_item", "- second"), ("paragraph", "after"), ("rule", ""), ("code", "code #"), ("image", "alt"), ("option", "A. option"), ("paragraph", "x"), ("equation", "y+1"), ("paragraph", "z"), ("table", "<table><tr>\n<td>1</td></tr></table>")]


def test_markup_frames(spark):
    rows = spark.createDataFrame([(1, "# a\n\nb"), (2, None), (3, "")], "id int, s string")
    assert sorted((r.id, r.kind) for r in markup.parse_markdown(rows, "id", "s").collect()) == [(1, "heading"), (1, "paragraph")]
    tables = spark.createDataFrame([(1, "<TABLE><tr><td>q</td></tr></TABLE>"), (2, None)], "id int, s string")
    assert [(r.id, r.text) for r in markup.html_table_cells(tables, "id", "s").collect()] == [(1, "q")]


def test_text_metrics(spark):
    rows = [("a b c", "a b d"), ("", ""), (None, "x"), ("5 apples", "5 apples")]
    got = [(round(r.character_error_rate, 4), round(r.word_error_rate, 4), r.exact_match) for r in metrics.text_metrics(spark.createDataFrame(rows, "reference string, candidate string")).collect()]
    assert got == [(0.2, 0.3333, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


def test_relationships_and_matching(spark):
    rows = spark.createDataFrame([(1, {"parent": "a"}, {"parent": "a", "next": "b"}), (2, {}, {})], "k int, r map<string,string>, c map<string,string>")
    assert {r.k: r.relationship_accuracy for r in metrics.relationship_accuracy(rows, ["k"], "r", "c").collect()} == {1: 0.5, 2: 1.0}
    shape = "page_id int, element_id int, kind string, x0 double, y0 double, x1 double, y1 double, text string, reading_order int"
    a = [(1, i, "text", 0.0, 20.0 * i, 50.0, 20.0 * i + 10, f"line {i}", i) for i in range(4)]
    b = [(1, 10 + i, "text", 1.0, 20.0 * i, 51.0, 20.0 * i + 10, f"line {i}", i) for i in range(3)] + [(1, 20, "table", 0.0, 60.0, 50.0, 70.0, "line 3", 3)]
    got = sorted((r.reference_id, r.candidate_id) for r in matching.match_elements(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape), 100.0, 100.0).collect())
    assert got == [(0, 10), (1, 11), (2, 12)]


def test_withheld_and_nearest_rank(spark):
    rows = spark.createDataFrame([("a", 0.5, 1.0), ("a", None, 2.0), ("b", 1.0, 4.0)], "s string, score double, text double")
    got = {r.s: (r.mean_score, r.mean_text) for r in benchmarks.mean_scores(rows, ["s"], ["text"]).collect()}
    assert got == {"a": (0.25, None), "b": (1.0, 4.0)}
    steps = spark.createDataFrame([("p", float(i)) for i in range(1, 5)], "phase string, s double")
    r = benchmarks.phase_statistics(steps, ["phase"], "s").first()
    assert (r.p50, r.p95) == (2.0, 4.0)


def test_two_columns_and_boundaries(spark):
    shape = "page_id int, element_id string, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, "top", 0.0, 0.0, 100.0, 5.0), (1, "r1", 55.0, 10.0, 95.0, 20.0), (1, "l1", 5.0, 10.0, 45.0, 20.0), (1, "l2", 5.0, 30.0, 45.0, 40.0), (1, "r2", 55.0, 30.0, 95.0, 40.0), (1, "end", 0.0, 50.0, 100.0, 60.0)]
    got = sequences.reading_order(spark.createDataFrame(rows, shape), "page_id", F.lit(100.0)).orderBy("reading_order").collect()
    assert [r.element_id for r in got] == ["top", "l1", "l2", "r1", "r2", "end"]
    rows = [("d", p, f"h{p}", " Page  Title", 0.05) for p in range(3)] + [("d", 0, "x", "once", 0.05), ("d", 1, "m", "Page Title", 0.5), ("e", 0, "h", "Page Title", 0.05)]
    got = sequences.boundary_roles(spark.createDataFrame(rows, "doc string, page int, id string, text string, y double"), "doc", "page", F.col("y")).collect()
    assert {(r.doc, r.id, r.role) for r in got} == {("d", f"h{p}", "header") for p in range(3)}


def test_routing_turns_to_the_next_provider(spark):
    shape = "kind string, confidence double, existing string, readings array<string>, handwritten boolean, complex_layout boolean"
    rows = [("text", 0.5, "paddleocr", ["a"], False, False), ("text", 0.9, "paddleocr", ["a", "A "], False, False), ("table", None, None, [], False, False), ("text", 0.9, "x", ["a", "b"], True, False), ("image", 0.1, None, [], False, False), ("text", 0.6, "x", [], False, True)]
    got = [(r.kind, r.content, r.primary, r.action, r.cost) for r in routing.route(spark.createDataFrame(rows, shape)).collect()]
    assert got == [("text", "ordinary", "olmocr", "retry", 6.0), ("table", "table", "paddleocr", "extract", 1.0), ("text", "handwriting", "olmocr", "adjudicate", 6.0), ("text", "layout", "mineru", "retry", 6.0)]


def test_saved_results_become_elements(spark, tmp_path):
    aws = {"Blocks": [{"Id": "l", "BlockType": "LINE", "Page": 1, "Confidence": 90.0, "Geometry": {"BoundingBox": {"Left": 0.1, "Top": 0.2, "Width": 0.3, "Height": 0.1}}, "Relationships": [{"Type": "CHILD", "Ids": ["w1", "w2"]}]}, {"Id": "w1", "BlockType": "WORD", "Text": "Hello"}, {"Id": "w2", "BlockType": "WORD", "Text": "world"}]}
    paddle = {"rec_texts": ["a", "b"], "rec_scores": [0.9, 0.8], "rec_boxes": [[0, 0, 1, 1], [0, 2, 1, 3]]}
    mistral = {"model": "mistral-ocr", "pages": [{"index": 0, "markdown": "# x"}]}
    rows = spark.createDataFrame([("1", json.dumps(aws)), ("2", json.dumps(paddle)), ("3", json.dumps(mistral)), ("4", "{broken"), ("5", None)], "doc_id string, payload string")
    got = {(r.doc_id, r.text): (r.confidence, r.x1) for r in sniff.normalize(rows).collect()}
    assert got == {("1", "Hello world"): (0.9, pytest.approx(0.4)), ("2", "a"): (0.9, 1.0), ("2", "b"): (0.8, 1.0), ("3", "# x"): (None, None)}
    assert [r.provider for r in sniff.detect(rows).orderBy("doc_id").collect()] == ["aws_textract", "paddleocr", "mistral_ocr", None, None]
    (tmp_path / "a.jsonl").write_text('{"natural_text": "x"}\n\nnot json\n')
    assert sorted(r.valid for r in sniff.read_lines(spark, str(tmp_path)).collect()) == [False, True]
    (tmp_path / "a.tsv").write_text('level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t80\t"open\n5\t1\t1\t1\t1\t2\t10\t0\t9\t9\t-1\tb\n5\t1\t1\t1\t1\t3\t20\t0\t0\t9\t50\tgone\n')
    r = sniff.word_lines(sniff.read_word_table(spark, str(tmp_path / "a.tsv")), ["page_num", "block_num", "par_num", "line_num"]).first()
    assert (r.text, r.x0, r.x1, r.confidence) == ('"open b', 0, 19, 0.8)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, 0, "title", "T", None, 0.0, 0.0, 5.0, 5.0), ("d", 1, 1, "paragraph", "# not a heading", None, 0.0, 9.0, 5.0, 5.0), ("d", 2, 0, "heading", "H", 3, 0.0, 0.0, 5.0, 5.0), ("d", 2, 1, "figure", "a<b", None, 0.0, 7.0, 5.0, 9.0)], "doc string, page int, reading_order int, kind string, text string, level int, x0 double, y0 double, x1 double, y1 double")
    assert sinks.markdown(rows, "doc", "page").first().markdown == "# T\n\n\\# not a heading\n\n---\n\n### H\n\n[figure: a<b]"
    pages = json.loads(sinks.documents_json(rows, "doc", "page").first().json)["pages"]
    assert [len(p["elements"]) for p in pages] == [2, 2]
    assert "a&lt;b" in " ".join(r.html for r in sinks.absolute_html(rows, "doc", "page").collect())
    sinks.write_cached(rows, f"{tmp_path}/cache", ["doc"])
    assert sinks.misses(rows.withColumn("page", F.col("page") + 1), spark.read.parquet(f"{tmp_path}/cache"), ["doc", "page"]).count() == 2


def test_streaming_takes_each_line_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"natural_text": "x"}\n')
    for n in (1, 2):
        q = ingest.to_table(ingest.payload_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").count() == n
        (tmp_path / "in" / f"b{n}.txt").write_text('{"Blocks": []}\n')
    assert {r.provider for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"olmocr", "aws_textract"}
