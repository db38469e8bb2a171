import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_run_in_order_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        ids = [r.doc_id for r in rows]
        assert len(set(ids)) == len(ids) and set(ids) <= set(before)
        if k < 4:
            assert docs.columns == names and all(r.text == before[r.doc_id] for r in rows)
            assert len(ids) > 0.6 * len(before)
        before = {i: before[i] for i in ids}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(before)
