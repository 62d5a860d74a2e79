import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4]
    assert [n for n, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "mixing sources"]
    mixed = P.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() > 0 and set(docs.columns) <= set(mixed.columns)


def test_run(spark):
    rows = P.run(spark, SF)
    assert rows.count() > 0 and rows.where("n_chars <> length(text)").count() == 0
