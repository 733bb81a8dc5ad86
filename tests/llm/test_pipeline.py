import corpus_pipeline
from docgraph.llm import queries


def test_stages_keep_the_columns_of_documents(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i * 3 + 1, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == plain.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.count() > 0
    ids = [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "near_dedup")).collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "bpe"]
