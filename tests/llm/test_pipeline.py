"""The pipeline end to end on the smallest tables: each stage's decisions against what its operator says."""

import corpus_pipeline
from tessera.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    for d in seen[1:-1]:
        assert sorted(d.columns) == sorted(docs.columns)
    kept = {r.doc_id for r in quality.compression_bands(docs).where("kept").collect()}
    assert {r.doc_id for r in seen[1].select("doc_id").collect()} == kept
    first = {r.component_id for r in simhash.near_duplicates(seen[1]).collect()}
    assert {r.doc_id for r in seen[2].select("doc_id").collect()} == first
    assert seen[3].count() == seen[4].count() == seen[2].count()
    assert seen[4].where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.]'").count() == 0
    assert seen[4].where("n_chars <> length(text)").count() == 0
    assert {r.doc_id for r in seen[5].select("doc_id").collect()} == first
    assert seen[5].groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_null_and_repeated_ids(spark):
    def text(k):
        return " ".join(f"w{k}x{i * i}" for i in range(80))

    rows = [(1, text(1)), (2, text(2)), (2, text(1)), (3, text(3)), (3, text(3)), (4, text(3)), (5, text(5)), (5, text(6)), (None, text(7)), (None, text(8)), (None, text(7)), (None, text(1))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    want = [(1, text(1)), (2, text(2)), (3, text(3)), (5, text(5)), (5, text(6)), (None, text(7)), (None, text(8))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "", None, None, 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)], docs.schema)
    assert corpus_pipeline.quality_rules(spark, odd, SF).count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd, SF).collect()) == [1, 3]
    for stage in (corpus_pipeline.repeated_passages, corpus_pipeline.personal_data):
        assert sorted(((r.doc_id or 0, r.text, r.n_chars) for r in stage(spark, odd, SF).collect())) == [(0, "", 0), (1, "", 0), (2, "", 0), (3, "a b", 3), (3, "a b", 3)]
    assert corpus_pipeline.packed(spark, odd, SF).count() == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), SF).count() == 0
    left = corpus_pipeline.personal_data(spark, corpus_pipeline.repeated_passages(spark, kept, SF), SF)
    assert left.count() == len(want) and left.where("doc_id is null and n_chars > 0").count() == 2
