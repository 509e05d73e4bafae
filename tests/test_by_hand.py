"""Queries and operators that SQL cannot express, against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import catalog
from quire.fixtures import observations, readings
from quire.functions import ids, text
from quire.operators import alignment, columns, consensus, evidence, graphs, matching, routing
from quire.plans import fusion

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edits():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(2))
        assert text.edits(a, b) == distance(a, b)
    assert text.edits([], ["x"]) == 1 and text.edits("", "") == 0


def test_numbers_of_documents(spark):
    import regex

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_numbers for r in catalog.document_numbers(spark, SF).collect()}
    assert got == {d: len(regex.findall(text.NUMBER, t)) for d, t in texts.items()}
    odd = spark.createDataFrame([("1,000 2-3 +4.5% 2021-01-02 1 2 −7 x8 9.9.9",)], "t string")
    assert odd.select(text.numbers(F.col("t")).alias("n")).first().n == ["1000", "2", "3", "+4.5%", "2021", "01", "02", "1", "2", "-7", "9.9"]


def test_text_metrics_of_shared_lines(spark, tmp_path):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "12", "3.5", "gamma"]) for _ in range(4))
    benchmark = [(i, "\n".join(line() for _ in range(2))) for i in range(12)]
    docs = [(i, "\n".join([line(), benchmark[i % 12][1].split("\n")[0].upper() if i % 3 else "nothing", line()])) for i in range(40)]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    keys = lambda t: {" ".join(x.split()).lower() for x in t.split("\n")}
    acc = lambda a, b: 1 - distance(a, b) / max(len(a), len(b), 1)
    want = {}
    for (i, a), (d, b) in itertools.product(benchmark, docs):
        if keys(a) & keys(b):
            number = lambda t: [x.replace(",", "") for x in re.findall(text.NUMBER, t)]
            parts = acc(a, b), acc(a.split(), b.split()), acc(number(a), number(b))
            want[i, d] = (*parts, 0.45 * parts[0] + 0.35 * parts[1] + 0.10 * (a == b) + 0.10 * parts[2])
    got = {(r.item_id, r.doc_id): (r.character_accuracy, r.word_accuracy, r.numerical_accuracy, r.text_score) for r in catalog.text_metrics(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and len(want) > 20
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_markdown_blocks_of_documents(spark):
    """Every line of a document is in some block, and plain documents have a paragraph a run of lines."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = defaultdict(dict)
    for r in catalog.markdown_blocks(spark, SF).collect():
        counts[r.doc_id][r.kind] = r.n
    plain = {d: t for d, t in texts.items() if t.strip() and not re.search(r"(?m)^\s*([#>|`~*+=-]|\d+[.)]|<|!|\$|[A-Da-d][.)])|:\s*$|\$|\\\\", t) and re.search(r"[a-z]{3}", t)}
    assert len(plain) > 20
    for d in plain:
        assert set(counts[d]) <= {"paragraph", "heading"} and 1 <= sum(counts[d].values()) <= len([x for x in texts[d].split("\n") if x.strip()])


def test_least_cost_assignments():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 4), (4, 4), (3, 6), (5, 5)):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, m)).astype(float)
            got = matching.least_cost(cost)
            assert len(set(got.tolist())) == n
            assert cost[np.arange(n), got].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_assignments_of_sparse_scores():
    rng = random.Random(4)
    for _ in range(60):
        scores = {(i, j): rng.random() for i in range(5) for j in range(4) if rng.random() < 0.4}
        sets = [s for k in range(5) for s in itertools.combinations(scores, k) if len({a for a, _ in s}) == len({b for _, b in s}) == k]
        value = lambda s: sum(scores[p] for p in s)
        assert value(matching.assign(scores, whole=False)) == pytest.approx(max(map(value, sets)))
        best = max(sets, key=lambda s: (len(s), value(s)))
        got = matching.assign(scores)
        assert len(got) == len(best) and value(got) == pytest.approx(value(best))


def test_matched_elements_cost_least(spark):
    """All assignments of small pages: none costs less."""
    rows = observations(spark, SF).where("page_id < 400").withColumn("reading_order", F.col("element_id")).collect()
    got = defaultdict(dict)
    for r in catalog.matched_elements(spark, SF).where("page_id < 400").collect():
        got[r.page_id][r.reference_id, r.candidate_id] = r.cost
    pages = defaultdict(lambda: ([], []))
    for r in rows:
        if r.source in ("src0", "src1"):
            pages[r.page_id][r.source == "src1"].append(r)
    texts = matching.TEXT_KINDS
    for page, (left, right) in pages.items():
        kind = lambda r: "text" if r.kind in texts else r.kind
        for side in (left, right):
            side.sort(key=lambda r: (kind(r), r.reading_order))
        cost = {}
        for (i, a), (j, b) in itertools.product(enumerate(left), enumerate(right)):
            if a.kind != b.kind and kind(a) != kind(b):
                continue
            w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
            both = max(0, w) * max(0, h)
            share = both / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - both)
            near = max(0, 1 - math.dist(((a.x0 + a.x1) / 2, (a.y0 + a.y1) / 2), ((b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2)) / math.hypot(160, 200))
            size = (min(a.x1 - a.x0, b.x1 - b.x0) / max(a.x1 - a.x0, b.x1 - b.x0) + min(a.y1 - a.y0, b.y1 - b.y0) / max(a.y1 - a.y0, b.y1 - b.y0)) / 2
            words = distance(a.text.lower(), b.text.lower()) / max(len(a.text), len(b.text))
            cost[a.element_id, b.element_id] = 0.45 * (1 - (share + near) / 2) + 0.25 * words + 0.15 * 0.35 * (a.kind != b.kind) + 0.10 * (1 - size) + 0.05 * abs(i - j) / (max(len(left), len(right), 2) - 1)
        least = 0.0
        for k in range(1, min(len(left), len(right)) + 1):
            for some in itertools.permutations([r.element_id for r in right], k):
                for own in itertools.combinations([r.element_id for r in left], k):
                    pairs = list(zip(own, some, strict=True))
                    if all(p in cost for p in pairs):
                        least = min(least, sum(cost[p] - 0.8 for p in pairs))
        assert all(c == pytest.approx(cost[p], abs=1e-8) for p, c in got[page].items())
        assert sum(c - 0.8 for c in got[page].values()) == pytest.approx(least, abs=1e-6)


def test_many_elements_meet_their_own_in_a_band(spark):
    rows = [(1, i, "text", 0.0, 10.0 * i, 50.0, 10.0 * i + 8, f"line {i}", i, f"n{i}") for i in range(150)]
    schema = "page_id long, element_id long, kind string, x0 double, y0 double, x1 double, y1 double, text string, reading_order int, name string"
    left = spark.createDataFrame(rows, schema)
    right = left.where("element_id % 10 <> 3").withColumn("element_id", F.col("element_id") + 1000)
    got = matching.match_elements(left, right, 100.0, 1500.0).collect()
    assert {(r.reference_id, r.candidate_id) for r in got} == {(i, i + 1000) for i in range(150) if i % 10 != 3}


def test_fused_pages_agree_with_the_reducers_in_any_order(spark):
    rows = readings(spark, SF).where("page_id < 1500").cache()
    whole = sorted(map(tuple, fusion.fuse(rows).collect()))
    assert whole == sorted(map(tuple, fusion.fuse(rows.orderBy(F.rand(7)).repartition(5)).collect()))
    clusters = rows.join(matching.fuse_pages(rows), ["page_id", "element_id", "source"]).cache()
    sizes = clusters.groupBy("page_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("s")).collect()
    assert all(r.n == r.s for r in sizes) and any(r.n > 1 for r in sizes)
    key, got = ["page_id", "cluster"], {(r.page_id, r.cluster): r for r in fusion.fuse(rows).collect()}
    for r in consensus.fuse_boxes(clusters, key).collect():
        assert [got[r.page_id, r.cluster][c] for c in ("x0", "y0", "x1", "y1")] == pytest.approx([r.x0, r.y0, r.x1, r.y1])
    assert all(got[r.page_id, r.cluster].kind == r.kind for r in consensus.choose_type(clusters, key).collect())
    assert all((got[r.page_id, r.cluster].chosen_text, got[r.page_id, r.cluster].votes) == (r.chosen_text, r.votes) for r in consensus.choose_text(clusters, key).collect())
    for r in consensus.noisy_or(clusters, key).collect():
        assert got[r.page_id, r.cluster].confidence == (None if r.confidence is None else pytest.approx(r.confidence))


def test_texts_vote_by_their_folded_key(spark):
    rows = [(1, 1, "a", "text", 0.0, 0.0, 10.0, 10.0, 0.9, "Cafe\u0301"), (1, 2, "b", "text", 0.0, 0.0, 10.0, 10.0, 0.5, "CAF\u00c9"), (1, 3, "c", "text", 0.0, 0.0, 10.0, 10.0, None, "caf\u00e9 "), (2, 4, "a", "text", 0.0, 0.0, 9.0, 9.0, None, None)]
    got = {r.page_id: r for r in fusion.fuse(spark.createDataFrame(rows, "page_id long, element_id long, source string, kind string, x0 double, y0 double, x1 double, y1 double, confidence double, text string")).collect()}
    assert (got[1].votes, got[1].chosen_text, got[1].sources) == (3, "Cafe\u0301", 3)
    assert got[2].chosen_text is None and got[2].confidence is None


def brute_tables(tables, ruled):
    out, k, group, wide = [], 0, None, 0
    for block, n_rows, n_columns, own in tables:
        while k < len(ruled) and not (ruled[k][2] >= max(2, math.ceil((n_columns + 1) * 0.45)) and ruled[k][1] >= (2 if n_rows >= 2 else 1)):
            k += 1
        if k == len(ruled):
            return out
        chosen = ruled[k]
        if k and own is not None and own == group and ruled[k - 1][3] >= 4.5 and ruled[k - 1][2] >= max(n_columns + 1, wide + 1):
            chosen = ruled[k - 1]
        else:
            k += 1
        fit = 0.65 if chosen[1] == 0 else 1 / (1 + abs(chosen[1] - (n_rows + 1)))
        out.append((block, chosen[0], max(0.35, min(0.92, 0.45 + 0.22 * fit + 0.25 / (1 + abs(chosen[2] - (n_columns + 1)))))))
        group, wide = own, n_columns
    return out


def test_matched_tables(spark):
    rng = random.Random(5)
    tables, ruled, want = [], [], []
    for d in range(80):
        t = [(i, rng.randrange(4), rng.randrange(1, 5), rng.choice([None, "g"])) for i in range(rng.randrange(6))]
        r = [(i, rng.randrange(6), rng.randrange(8), rng.uniform(1, 8)) for i in range(rng.randrange(7))]
        tables += [(d, *x) for x in t]
        ruled += [(d, *x) for x in r]
        want += [(d, *x) for x in brute_tables(t, r)]
    got = evidence.match_tables(spark.createDataFrame(tables, "d long, block_index long, rows long, columns long, group_id string"), spark.createDataFrame(ruled, "d long, place long, horizontal_rules long, vertical_rules long, aspect double"), "d").collect()
    assert sorted((r.d, r.block_index, r.place, round(r.confidence, 9)) for r in got) == sorted((d, b, p, round(c, 9)) for d, b, p, c in want)


def test_columns_are_cut_where_squares_are_least():
    rng = np.random.default_rng(6)
    spread = lambda x: ((x - x.mean()) ** 2).sum()
    for k in (2, 3):
        for _ in range(40):
            x = np.sort(rng.uniform(0, 100, rng.integers(2 * k, 12)))
            cuts = columns.best_cuts(x, k)
            least = min(sum(map(spread, np.split(x, c))) for c in itertools.combinations(range(1, len(x)), k - 1))
            assert sum(map(spread, np.split(x, cuts))) == pytest.approx(least)


def brute_chain(rows):
    best = ((0.0, 0, 0), [])
    for k in range(1, len(rows) + 1):
        for some in itertools.combinations(sorted(rows, key=lambda r: (r.block_index, r.first)), k):
            if all(a.block_index < b.block_index and a.end <= b.first for a, b in itertools.pairwise(some)):
                best = max(best, ((round(sum(r.score for r in some), 9), k, -some[-1].end), list(some)), key=lambda s: s[0])
    return best[0]


def test_chains_of_candidates():
    from collections import namedtuple

    Found = namedtuple("Found", "block_index first end score")
    rng = random.Random(9)
    for _ in range(80):
        rows = [Found(rng.randrange(5), a, a + rng.randrange(1, 4), round(rng.uniform(0.6, 1), 2)) for a in (rng.randrange(8) for _ in range(rng.randrange(9)))]
        got = alignment._choose(rows)
        assert all(a.block_index < b.block_index and a.end <= b.first for a, b in itertools.pairwise(got))
        want = brute_chain(rows)
        assert (round(sum(r.score for r in got), 9), len(got)) == want[:2]


def test_edges_without_cycles_and_leaves_at_any_depth(spark):
    edges = spark.createDataFrame([(1, "a", "b", 0.9), (1, "b", "c", 0.8), (1, "c", "a", 0.7), (1, "a", "c", 0.95), (2, "x", "x", 1.0), (None, "p", "q", 1.0)], "page long, src string, dst string, confidence double")
    assert sorted((r.page, r.src, r.dst) for r in graphs.acyclic(edges, "page").collect()) == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]
    assert {(r.node, r.layer) for r in graphs.topological_layers(edges, "page").where("page = 1").collect()} == {("a", -1), ("b", -1), ("c", -1)}
    deep = [("o", f"e{k}", f"e{k - 1}" if k else None, "Ensemble") for k in range(30)] + [("o", "leaf", "e29", "Mineru"), ("p", "q", None, "Ensemble"), ("r", "s", None, "X")]
    got = {(r.owner, r.engine) for r in graphs.leaf_engines(spark.createDataFrame(deep, "owner string, id string, parent string, engine string")).collect()}
    assert got == {("o", "mineru"), ("p", "ensemble"), ("r", "x")}


def test_fingerprints_do_not_depend_on_order(spark):
    rows = spark.range(500).selectExpr("id", "if(id % 7 = 0, null, 'x') as s")
    one = lambda d: ids.fingerprint(d, "id", "s").first()
    assert one(rows) == one(rows.orderBy(F.rand(3)).repartition(9))
    assert one(rows).fingerprint != one(rows.union(rows.limit(1))).fingerprint
    assert one(rows.limit(0)).n_rows == 0


def test_many_providers_are_ranked_as_few(spark):
    providers = spark.range(1200).selectExpr("concat('p', id) as provider", "cast(id % 3 as int) as privacy", "cast(id % 5 as int) as cost", "id % 2 = 0 as needs_credentials", "array('local') as modes", "id % 4 = 0 as tables")
    requests = spark.createDataFrame([(1, "local", True), (2, None, False)], "request long, mode string, tables boolean")
    many = routing.rank_providers(requests, providers, ["tables"])
    assert Counter(r.request for r in many.collect()) == {1: 1200, 2: 1200}
    few = routing.rank_providers(requests, providers.limit(1000), ["tables"]).select("request", "provider", "score").exceptAll(many.select("request", "provider", "score"))
    assert few.count() == 0


def test_edges_of_regions_need_no_join_and_close_no_cycle(spark):
    """What makes the regions is worked out once for both kinds of edges, and every edge leads forward."""
    import random
    import re

    from quire.operators import graphs, topology

    rng = random.Random(7)
    kinds = ["header", "column", "column", "table", "floating", "footnote", "footer", "caption"]
    rows = [(p, f"r{i}", kinds[rng.randrange(8)], *(lambda x, y: (x, y, x + rng.randrange(1, 40), y + rng.randrange(1, 40)))(float(rng.randrange(40)), float(rng.randrange(40)))) for p in range(40) for i in range(12)]
    regions = spark.createDataFrame(rows, "page_id long, region_id string, region_kind string, x0 double, y0 double, x1 double, y1 double")
    edges = topology.page_edges(regions, "page_id")
    assert not re.search("Join (Inner|LeftOuter)", edges._jdf.queryExecution().optimizedPlan().toString())
    both = topology.semantic_edges(regions, "page_id").unionByName(topology.precedence_edges(regions, "page_id"))
    found = sorted(edges.collect())
    assert found == sorted(both.collect()) == sorted(graphs.acyclic(edges, "page_id").collect()) and len(found) > 1000
    assert {r.reason for r in found} == {"semantic.page_header", "semantic.page_footer", "semantic.page_footnote", "geometry.vertical_precedence"}


def _sorts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_roles_need_the_order_of_blocks_only(spark):
    """One sort, so that a task holds its blocks once; quoted runs of one to four."""
    from quire.operators import revision

    said = ["(1) a", "x", "(1) a", "(2) b", "x", "(1) a", "(2) b", "(3) c", "(a note)", "(1) a", "(2) b", "(3) c", "(4) d"]
    blocks = spark.createDataFrame([(d, i, "paragraph", x, False) for d in (1, 2) for i, x in enumerate(said)], "doc long, block_index int, kind string, text string, starts_group boolean")
    out = revision.structural_roles(blocks, "doc")
    assert _sorts(out) == 1
    found = {(r.doc, r.block_index): r.role for r in out.collect()}
    assert {k: v for k, v in found.items() if v} == {(d, i): "attribution" if i == 8 else "quoted_passage" for d in (1, 2) for i in range(5, 13)}


def test_banners_of_pages_that_go_on_later(spark):
    """A page that is taken up again after another one has its end there; other sorts see links and beginnings only."""
    from quire.operators import revision

    rows = [(1, "p. 1 / 3"), (1, "www.a.org"), (2, "p. 2 / 3"), (2, "WWW.a.org "), (3, "x"), (2, "late"), (1, "p. 1 / 3"), (1, "www.b.org"), (3, "www.b.org")]
    placed = spark.createDataFrame([(7, i, p, "paragraph", x, 5, 0, 1000, 3) for i, (p, x) in enumerate(rows)], "doc long, block_index int, page int, kind string, text string, y0 int, content_top int, content_height int, pages int")
    out = revision.misplaced_banners(placed, "doc")
    assert [tuple(r) for r in out.collect()] == [(7, 7, 1, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_begins" in plan


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_elements_without_a_partner_are_those_of_no_pair(spark):
    """Against correlated_pairs(), with boxes over several cells, none, and of no source; without a join."""
    import random
    import re

    from quire.operators import matching

    rng = random.Random(3)
    place = lambda: (float(rng.randrange(-80, 150)), float(rng.randrange(0, 150)))
    rows = [(p, i, rng.choice(["a", "b", None]), rng.choice(["text", "title", "table", "unknown"]), x, y, x + rng.randrange(1, 200), y + rng.randrange(1, 90)) for p in range(20) for i in range(9) for x, y in [place()]]
    rows += [(1, 90, "a", "text", None, 1.0, None, 2.0), (1, 91, "b", "text", 1.0, None, 2.0, None), (None, 92, "a", "text", 0.0, 0.0, 9.0, 9.0), (None, 93, "b", "text", 0.0, 0.0, 9.0, 9.0)]
    rows = spark.createDataFrame(rows, "page_id long, element_id long, source string, kind string, x0 double, y0 double, x1 double, y1 double")
    met = matching.correlated_pairs(rows, least=0.1)
    hit = met.select("page_id", "element_id").union(met.select("page_id", "element_id2")).distinct()
    out = matching.unmatched(rows, least=0.1)
    some = lambda d: sorted(d.select("element_id", "page_id").na.fill(-1).collect())
    assert some(out) == some(rows.join(hit, ["page_id", "element_id"], "left_anti")) and hit.count() > 20
    assert not re.search("Join (Inner|Left)", _plan(out))


def test_rows_of_a_page_are_covered_without_joins(spark):
    from quire.operators import revision

    placed = spark.createDataFrame([(1, 0.0, 10.0), (1, 20.0, 30.0), (1, None, None), (2, None, None), (3, 0.0, 5.0)], "page long, y0 double, y1 double")
    slots = spark.createDataFrame([(1, 0.5, 9.5), (1, 0.5, 9.5), (1, 24.0, 40.0), (2, 0.0, 4.0), (4, 0.0, 2.0)], "page long, y0 double, y1 double")
    out = revision.plan_geometry(placed, slots, ["page"])
    assert "Join " not in _plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3, 2, 3, 2, 29.5 / 39.5), (2, 1, 0, 1, 0, 0.0), (3, 1, 1, 0, 0, 1.0), (4, 0, 0, 1, 0, 0.0)]


def test_boxes_and_anchors_of_units_are_joined_once(spark):
    from quire.operators import alignment

    units = spark.createDataFrame([("d", "a", 1, i, "text", x, 0.9, float(i), 0.0, i + 1.0, 1.0) for i, x in enumerate(["x", "Y z", "x", "w"])] + [("d", None, 2, 0, "text", "x", 0.9, 5.0, 5.0, 6.0, 6.0)], "doc_id string, source string, page int, position long, kind string, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([("d", 0, "x  y Z"), ("d", 1, "w"), ("d", 2, "x")], "doc_id string, block_index int, text string")
    anchors = alignment.exact_anchors(blocks, units, 2)
    assert _plan(anchors).count("Join ") == 1
    assert sorted((r.source or "", r.block_index, r.first) for r in anchors.collect()) == [("", 2, 0), ("a", 0, 0), ("a", 1, 3)]
    matches = spark.createDataFrame([("d", "a", 0, 0, 2, 0.5), ("d", "a", 1, 3, 9, None)], "doc_id string, source string, block_index int, first int, end int, score double")
    boxes = alignment.consensus_boxes(matches, units)
    assert _plan(boxes).count("Join ") == 1
    assert sorted(tuple(r) for r in boxes.collect()) == [("d", 0, 1, 1, 0.0, 0.0, 2.0, 1.0), ("d", 1, 1, 1, 3.0, 0.0, 4.0, 1.0)]


def test_only_the_box_names_of_a_payload_are_looked_for(spark):
    from quire.sources import payloads

    said = ['{"left":1,"top":2,"right":3,"bottom":4}', '{"x":1,"y":2,"width":3,"height":4}', '{"x0":1}', '{"region":{"xmin":5,"ymin":6,"xmax":1,"ymax":2}}', "[1,2,3,4]", '{"x\\u0030":1,"y0":2,"x1":3,"y1":4}', "{", None]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, payload string")
    out = rows.select("i", payloads.coerced_box(rows.payload).alias("b"))
    assert "array_contains" in _plan(out)
    found = {r.i: r.b and tuple(r.b) for r in out.collect()}
    assert found == {0: (1, 2, 3, 4), 1: (1, 2, 4, 6), 2: None, 3: (1, 2, 5, 6), 4: (1, 2, 3, 4), 5: (1, 2, 3, 4), 6: None, 7: None}


def test_fused_rows_pass_through_whole_without_a_join(spark):
    """Pages over several batches, unknown and odd numbers; and assignments of single rows or columns against all choices."""
    from quire.operators import matching
    from quire.plans import fusion

    rows = [(p, i, f"src{i % 3}", "text", 0.0, 40.0 * (i // 3), 60.0, 40.0 * (i // 3) + 30, (None, float("nan"), 0.5)[i % 3], f"Line {i // 3} of {p}") for p in range(6) for i in range(9 if p != 2 else 60)]
    rows = spark.createDataFrame(rows, "page_id long, element_id long, source string, kind string, x0 double, y0 double, x1 double, y1 double, confidence double, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = matching.clustered(rows).collect()
        assert "Join " not in _plan(fusion.fuse(rows))
        assert len(fusion.fuse(rows).collect()) == 5 * 3 + 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(out) == 5 * 9 + 60 and all(r.cluster == r.element_id // 3 and r.key == r.text.lower() for r in out)
    assert all((r.confidence is None, r.confidence != r.confidence, r.confidence == 0.5)[r.element_id % 3] for r in out)
    assert matching.assign({(0, 3): 0.5, (0, 2): 0.5, (0, 9): 0.1}) == [(0, 2)] and matching.assign({(4, 1): 0.2, (5, 1): 0.9}) == [(5, 1)] and matching.assign({(7, 8): 0.1}, whole=False) == [(7, 8)]
