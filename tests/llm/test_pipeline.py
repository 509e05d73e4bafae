from collections import Counter

import corpus_pipeline
import pytest
from quire.llm import jaccard, packing, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = kept
        kept = stage(spark, before, SF)
        assert kept.columns == docs.columns
        if k == 0:
            want = {r.doc_id for r in quality.judge(before).collect() if r.kept}
        elif k == 1:
            want = {r.doc_id for r in toxicity.score(before, labels).collect() if not r.predicted}
        else:
            want = {r.component_id for r in jaccard.near_duplicates(before, 5, 80).collect()}
        assert {r.doc_id for r in kept.collect()} == want
    packed = corpus_pipeline.run(spark, SF).collect()
    want = packing.token_pieces(kept).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in packed} == {(r.doc_id, r.piece, r.ids_crc32) for r in want}


GOOD = " ".join(f"word{i} and more" for i in range(20))


def awkward(spark):
    rows = [(1, GOOD, "en", "a"), (1, GOOD, "en", "a"), (2, GOOD + " x", None, None), (3, None, "en", "a"), (4, "", "en", "b"), (None, GOOD.replace("word", "thing"), "en", "b"), (5, "same words here " * 60, "en", "c"), (6, "long " + " ".join(f"v{i}" for i in range(30_000)), "en", "c"), (7, GOOD.replace("word", "other"), "en", "a"), (8, GOOD.replace("word", "other"), "en", "d")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "7 as score", "'x' as _row", "1 as part", "'y' as cls", "2L as n", "3 as failed", "4 as length")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (7, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    awkward(spark).write.parquet(f"{at}/documents.parquet")
    awkward(spark).limit(0).write.parquet(f"{at}-empty/documents.parquet")
    spark.read.parquet(f"{at}/labels.parquet").limit(0).write.parquet(f"{at}-empty/labels.parquet")
    return str(at)


def test_stages_with_awkward_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    want = [{1: 2, 2: 1, None: 1, 6: 1, 7: 1, 8: 1}, {1: 2, 2: 1, None: 1, 6: 1, 7: 1, 8: 1}, {1: 2, None: 1, 6: 1, 7: 1}]
    for (_, stage), kept in zip(corpus_pipeline.STAGES[:3], want, strict=True):
        columns = docs.columns
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        rows = docs.collect()
        assert Counter(r.doc_id for r in rows) == kept
        assert all(r.score == 7 and r._row == "x" and r.cls == "y" and r.n_chars == len(r.text) for r in rows)
    packed = corpus_pipeline.STAGES[3][1](spark, docs, tables).collect()
    assert sum(r.length for r in packed) == sum(r.length for r in packing.token_pieces(docs).collect())


def test_stages_of_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}-empty/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"{tables}-empty").count() == 0
    assert corpus_pipeline.run(spark, f"{tables}-empty").count() == 0


def test_idle_workers_hold_no_free_memory(spark):
    def freed(batches):
        """How many MB an idle worker that has encoded texts still holds without need, if it has encoded any."""
        import ctypes
        import re
        import sys

        import pyarrow as pa

        def mb():
            with open("/proc/self/smaps_rollup") as f:
                return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

        for batch in batches:
            if getattr(sys.modules.get("quire.llm.pieces"), "_encoders", None):
                before = mb()
                pa.default_memory_pool().release_unused()
                ctypes.CDLL("libc.so.6").malloc_trim(0)
                yield pa.RecordBatch.from_pydict({"mb": [before - mb()]})
            else:
                yield pa.RecordBatch.from_pydict({"mb": pa.array([], pa.float64())})

    docs = spark.range(0, 1200, 1, 4).selectExpr("id as doc_id", "array_join(transform(sequence(1, 400), i -> hex(xxhash64(id, i))), ' ') as text")
    packing.token_pieces(docs).write.format("noop").mode("overwrite").save()
    got = [r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(freed, "mb double").collect()]
    assert got and max(got) < 15


def test_toxicity_stage_returns_a_written_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = toxicity.keep_clean(docs, spark.read.parquet(f"{SF}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
