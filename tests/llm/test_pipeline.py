import corpus_pipeline
from tests.llm.conftest import ODD
from tests.llm.test_decontaminate import brute
from tests.llm.test_secrets import base
from tidewatch.llm.tables import materialize


def test_stages_on_the_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, left = docs.columns, [docs.count()]
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = materialize(stage(spark, docs, small), f"test-{name}")
        after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        left.append(len(after))
        if name != "mixing":
            assert docs.columns == names
        if name == "language":
            assert set(after) == {i for i, t in before.items() if any(map(str.isalpha, t or ""))}
        if name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not brute(t, bench)[1]}
        if name == "secrets":
            assert set(after) == set(before)
            assert {i for i in after if after[i] != before[i]} == {i for i, t in before.items() if base(t)}
    assert left[0] > left[2] > left[3] >= left[5] > 0
    assert docs.filter("copy > copies OR copies > 3").count() == 0


def test_odd_documents_pass_every_stage(spark, odd, nothing, small):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, small).count() <= 3 * len(ODD)
