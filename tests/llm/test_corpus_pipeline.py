"""The pipeline's stages on tables with known copies."""

from collections import Counter

import corpus_pipeline
from changesync.llm import best_fit


def test_stages(spark, awkward, nothing, tmp_path, clash):
    spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "doc_id LONG, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    assert [s.__name__ for _, s in corpus_pipeline.STAGES] == ["drop_toxic", "drop_copies", "drop_near_copies", "mix_sources", "pack_sequences"]
    for table in (clash(awkward), nothing):
        docs = table
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{table.count()}-{i}"
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if i < 4:
                assert docs.columns == table.columns, name
        assert docs.filter(f"offset + length > {best_fit.Packing().tokens}").count() == 0


def test_one_row_of_each_copy_stays(spark, awkward, tmp_path):
    awkward.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    kept = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert len({r.text for r in kept}) == len(kept)
    assert Counter(r.doc_id for r in kept)[3] == 1
    near = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    prose = [r for r in near if r.text and "lazy dog while" in r.text]
    assert sorted(r.doc_id for r in prose) == [0, 2]  # the twice repeated prose has few shingles more


def test_whole_run(spark, small, tmp_path):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in small.collect()}


def test_near_copies_between_80_and_85_percent_go(spark):
    base = [f"w{i}" for i in range(400)]
    appended = base + [f"new{i}" for i in range(80)]
    replaced = base[:100] + [f"other{i}" for i in range(35)] + base[135:]
    apart = base + [f"more{i}" for i in range(110)]  # 0.783 of the first text, 0.675 of the second
    rows = [(i, " ".join(t)) for i, t in enumerate((base, appended, replaced, apart))]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id LONG, text STRING"), "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 3]


def test_decisions_hit_their_rows_when_splits_change(spark, tmp_path):
    texts = [f"copy {i % 10} " * 20 if i < 40 else f"own{i} text{i} of{i} row{i} and{i} more{i}" for i in range(80)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(8, "doc_id").write.parquet(f"{tmp_path}/in")
    want = [*range(10), *range(40, 80)]
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
            out = stage(spark, spark.read.parquet(f"{tmp_path}/in"), "")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            assert sorted(r.doc_id for r in out.collect()) == want, stage.__name__
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.unset("spark.sql.files.minPartitionNum")
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.set(k, usual[k]) if k in usual else spark.conf.unset(k)


def test_columns_named_like_the_stages_own_stay(spark, tmp_path):
    spark.createDataFrame([(0, 0), (1, 1)], "doc_id LONG, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"some words of row {i} and more of them {i}", "en", "s", "A", "B", "C") for i in range(6)],
                                 "doc_id LONG, text STRING, lang STRING, source STRING, __row STRING, __Toxicity STRING, __passages STRING")
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {tuple(r)[4:] for r in out.collect()} <= {("A", "B", "C")}
