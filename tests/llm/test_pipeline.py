"""The pipeline on odd documents and on the smallest tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.common import edited, empty_docs, odd_docs, prose  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_stages_stand_alone(spark, kind):
    docs = empty_docs(spark) if kind == "empty" else odd_docs(spark, kind == "clashing")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_stages_take_effect(spark, tmp_path):
    base, passage, item = prose(1, 120), prose(2, 70), prose(3, 40)
    texts = {1: base, 2: base, 3: edited(base, 3, 0.01), 4: "too short", 5: prose(5, 90) + " " + passage, 6: passage + " " + prose(6, 90), 7: prose(7, 50) + " " + item + " " + prose(8, 50), 8: prose(9, 80)}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["quality"]) == {1, 2, 3, 5, 6, 7, 8}
    assert set(seen["near_dedup"]) == {1, 5, 6, 7, 8}
    cut = seen["suffix_dedup"]
    assert passage not in cut[5]["text"] and cut[1]["text"] == base and cut[5]["n_chars"] == len(cut[5]["text"])
    assert set(seen["decontaminate"]) == {1, 5, 6, 8}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.collect()} == {1, 5, 6, 8}
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in docs.collect())


def test_bench_leaves_no_operator_out():
    import __spark_entry__
    import bench
    from lagoon.llm import queries

    asked = {*queries.queries(), "pipeline"}
    assert asked <= set(bench.HEADLINE) and asked <= set(__spark_entry__.queries())
