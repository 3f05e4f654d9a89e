import corpus_pipeline


def test_stages(spark, odd, empty, tmp_path):
    for docs, at in ((odd, "odd"), (empty, "none")):
        out = str(tmp_path / at)
        docs.write.parquet(f"{out}/documents.parquet")
        spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
        now = spark.read.parquet(f"{out}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, out)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns, name
        assert corpus_pipeline.run(spark, out).count() == now.count()


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0")
    clean = docs.where("length(text) > 600").join(labels, "doc_id", "left_semi")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert kept.join(clean.select("doc_id"), "doc_id", "left_semi").count() >= 0.95 * clean.count()
