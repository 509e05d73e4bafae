"""Queries that have to look at every row, against brute force."""

from __future__ import annotations

import re

from quire import catalog
from quire.operators import alignment

NUMBER = re.compile(r"(?<![\w.])[+\-−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?", re.ASCII)


def test_numbers_of_all_documents(spark, tmp_path):
    texts = ["2021-05-17", "1,000 or 12,345.5%", "10-20", "−5 +7 --8", "é5 and é 5", "555 1234", "1 2 3", "v1.2 3.4.5", "", None, "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_numbers for r in catalog.queries()["document_numbers"](spark, str(tmp_path)).collect()}
    assert got == {i: len(NUMBER.findall(x or "")) for i, x in enumerate(texts)}
    assert got[0] == 3 and got[1] == 2
    assert len(got) == len(texts)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, u in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
    return row[-1]


def _accuracy(a, b):
    return max(0.0, 1 - _edits(a, b) / max(len(a), len(b), 1))


def test_passages_meet_all_documents_that_share_a_line(spark, tmp_path):
    items = ["The common line\nsecond line 12", "the  COMMON line \nother words", "only here 5", "shared with none", None]
    docs = ["x\nThe common line\ny 1", "the common line\nthe common line", "second line 12\nother words", "The common line\nsecond line 12", "only here 5\nonly here 5", "", None, "common line"] + ["The common line"] * 40
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    keys = lambda x: {" ".join(y.split()).lower() for y in (x or "").split("\n")} - {""}
    want = {}
    for i, a in enumerate(items):
        for d, b in enumerate(docs):
            if keys(a) & keys(b):
                c, w, n = _accuracy(a, b), _accuracy(a.split(), b.split()), _accuracy(NUMBER.findall(a), NUMBER.findall(b))
                want[i, d] = tuple(round(x, 6) for x in (c, w, n, 0.45 * c + 0.35 * w + 0.10 * (a == b) + 0.10 * n))
    got = catalog.queries()["text_metrics"](spark, str(tmp_path)).collect()
    assert {(r.item_id, r.doc_id): tuple(round(x, 6) for x in r[2:]) for r in got} == want
    assert len(got) == len(want) > 80


def test_candidates_need_no_common_word(spark):
    odd = ["introductlon", "hel lo", "日本語の文草を読む", "e=mc^3+x"]
    want = ["introduction", "hello", "日本語の文章を読む", "e=mc^2+x"]
    few = [("few", "s", 1, i, "text", x, 0.9) for i, x in enumerate(odd)]
    many = [("many", "s", 1 + i // 100, i, "text", f"#{i:05d}#" if i % 150 else odd[i // 150], 0.9) for i in range(600)]
    units = spark.createDataFrame(few + many, "doc_id string, source string, page int, position int, kind string, text string, confidence double")
    blocks = spark.createDataFrame([(d, i, "paragraph", x) for d in ("few", "many") for i, x in enumerate(want)], "doc_id string, block_index int, kind string, text string")
    got = {(r.doc_id, r.block_index, r.first, r.end) for r in alignment.candidates(blocks, units).collect()}
    assert {("few", i, i, i + 1) for i in range(4)} | {("many", i, 150 * i, 150 * i + 1) for i in range(4)} <= got
    # All runs of the short document, by brute force.
    brute = set()
    for i, a in enumerate(want):
        for first in range(4):
            for end in range(first + 1, 5):
                like = alignment._alike(a, " ".join(odd[first:end]))
                if like >= 0.62 and 0.82 * like + 0.13 * 0.62 + 0.05 * 0.9 >= 0.62:
                    brute.add(("few", i, first, end))
    missing = brute - got
    assert not missing
