import corpus_pipeline
from zonegrid.llm import bpe_chunks


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing sources", "bpe"]


def test_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        was, left = left, stage(spark, left, sf)
        assert left.dtypes == docs.dtypes
        left = spark.createDataFrame(left.collect(), left.schema)
        assert {r["doc_id"] for r in left.collect()} <= {r["doc_id"] for r in was.collect()}
    staged = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, left, sf).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == staged and staged


def test_odd_rows(spark, sf, odd_docs, no_docs):
    for df in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, df, sf)
            assert got.columns == df.columns
            got.collect()
    assert corpus_pipeline.encode(spark, odd_docs, sf).count() == odd_docs.count()


def test_near_duplicates_leave_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 100_000)).unionByName(docs)
    kept = corpus_pipeline.drop_near_duplicates(spark, twice, sf).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and bpe_chunks.MEAN == 1024
