import corpus_pipeline


def test_stages_and_odd_documents(spark, folder, odd, empty):
    """Every stage takes any documents, and all but the last return the columns they were given."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            own = [c for c in docs.columns if name != "sharding" or c not in ("shard", "slot")]
            assert out.columns == own + (["shard", "slot"] if name == "sharding" else [])
            given, left = ([tuple(r) for r in df.select(*own).collect()] for df in (docs, out))
            assert set(left) <= set(given) and len(left) <= 2 * len(given)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    counts = out.shard.value_counts()
    assert len(counts) == 8 and counts.max() - counts.min() <= 1
    assert out.groupby("doc_id").size().max() <= 2
