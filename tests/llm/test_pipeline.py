import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k == 1:
            kept = [labels.get(x.doc_id) for x in docs.select("doc_id").collect()]
            assert kept.count(1) >= 0.9 * list(labels.values()).count(1) - 2 and kept.count(0) <= 0.3 * list(labels.values()).count(0)
    assert counts[0] > counts[1] >= counts[2] > counts[3] and counts[4] != counts[3]
    run = corpus_pipeline.run(spark, SF)
    assert run.count() == counts[-1] and run.columns == docs.columns


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_classifier_is_fitted_on_more_than_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rest = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left_anti").select(docs.columns)
    stage = dict(corpus_pipeline.STAGES)["quality classifier"]
    alone, among = ({x.doc_id for x in stage(spark, d, SF).collect()} for d in (rest, docs))
    ids = {x.doc_id for x in rest.select("doc_id").collect()}
    # Whether a document stays is a matter of its text, not of what else is in the input.
    assert alone and alone == among & ids
