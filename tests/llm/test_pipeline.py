import corpus_pipeline as pipeline
from gridmere.llm import decontaminate, nearcopies
from tests.llm.test_decontaminate import plain_leaks

DATA = "/root/testdata/sf0.001"


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language", "near-duplicates", "benchmark", "encoding"]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        if name == "near-duplicates":
            assert ids(out) == {r["component_id"] for r in nearcopies.near_copies(docs).collect()}
        if name == "benchmark":
            leaky = {d for d, _ in plain_leaks(docs.select("doc_id", "text").collect(), spark.read.parquet(f"{DATA}/benchmark.parquet").collect())}
            assert leaky and ids(out) == ids(docs) - leaky
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        docs = spark.read.parquet(path)
    last = pipeline.STAGES[-1][1](spark, docs, DATA)
    run = pipeline.run(spark, DATA)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, run.collect()))
    assert ids(run) == ids(docs)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    kept = ids(pipeline.toxic_stage(spark, docs, path))
    clean, toxic = [i for i in labels if labels[i] == 0], [i for i in labels if labels[i] == 1]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean) and sum(i not in kept for i in toxic) >= 0.6 * len(toxic)  # few labels here


def test_odd_rows_pass_all_stages(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
    left = ids(kept)
    assert {1, 5, 7, 8, 9} <= left and not left & {2, 3, 4, 6, 10}
    assert pipeline.STAGES[-1][1](spark, kept, DATA).count() == kept.count()
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_leaks_are_judged_on_whole_texts():
    assert decontaminate.ENTRY >= decontaminate.SHINGLE
