import corpus_pipeline
from quire.llm import decontaminate, simhash


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    marks = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    found = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        found[name] = ids(out)
    good = {i for i, m in marks.items() if m["quality"] == 1}
    bad = {i for i, m in marks.items() if m["quality"] == 0}
    assert len(good - found["quality"]) < 0.03 * len(good) and len(bad & found["quality"]) < 0.05 * len(bad)
    mild = {i for i, m in marks.items() if m["toxic"] == 0}
    assert len(mild - found["toxicity"]) < 0.02 * len(mild)
    first = {}
    for r in simhash.similar(docs).collect():
        first[r["component"]] = min(r["doc_id"], first.get(r["component"], r["doc_id"]))
    assert found["near duplicates"] == set(first.values())
    mean = {i for i, m in marks.items() if m["toxic"] == 1}
    assert len(mean & found["toxicity"]) < 0.4 * len(mean)
    leaks = ids(decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert leaks and found["benchmark"] == ids(docs) - leaks
    docs.unpersist()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert rows and all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
