"""The stages one after another on small documents, and the registered queries."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from halyard.llm import queries
from halyard.sources.scratch import written
from tests.checking import compare
from tests.llm.frames import no_documents, odd_documents

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_feed_each_other(spark):
    folder = "/root/testdata/sf0.01"
    first = docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, folder), f"test-{name}")
        assert docs.dtypes == first.dtypes
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    assert sizes[-1] > 0.6 * sizes[0]
    assert docs.where(F.col("text").rlike("[0-9a-f]{24}")).count() == 0  # secrets are marked
    assert docs.where(F.col("text").contains("[secret]")).count() > 0
    pieces = corpus_pipeline.pack(spark, docs, folder)
    assert {r.id for r in pieces.select("id").collect()} == {r.doc_id for r in docs.collect()}


def test_copies_go_and_one_of_each_stays(spark):
    words = [f"word{i}" for i in range(60)]
    near = words[:30] + ["other"] + words[31:]
    rows = [(5, " ".join(words)), (3, " ".join(words)), (9, " ".join(near)), (7, " ".join(words[::-1])), (None, " ".join(words)), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]


def test_quality_judges_each_text_whatever_shares_its_id(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.text for r in corpus_pipeline.quality(spark, docs, FOLDER).collect()}
    gone = [r for r in docs.collect() if r.text not in kept]
    assert len(gone) > 20
    some = F.col("text").isin([r.text for r in gone]) | (F.col("doc_id") == min(r.doc_id for r in docs.collect() if r.text in kept))
    for shared in (None, 10**6):  # unlabelled ids: no text is a target through its id
        odd = docs.withColumn("doc_id", F.when(some, F.lit(shared).cast("long")).otherwise(F.col("doc_id")))
        out = corpus_pipeline.quality(spark, odd, FOLDER).collect()
        assert 0.8 * len(kept) < len(out) < docs.count() - 0.8 * len(gone)


def test_distinct_texts_without_or_with_equal_ids_stay(spark):
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(words[k:] + words[:k][::-1]) for k in (0, 20, 40)] + [" ".join(words[::-1]), " ".join(f"other{i}" for i in range(60))]
    rows = [(None, texts[0]), (None, texts[3]), (None, texts[4]), (1, texts[1]), (1, texts[2]), (2, texts[2]), (3, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((i or 0, t or "") for i, t in rows if (i, t) != (2, texts[2]))


def test_without_any_language_documents_with_letters_stay(spark):
    rows = [(1, "a clean text"), (2, "été"), (3, "12 !?"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id, r.lang) for r in kept) == [(1, None), (2, None)]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_and_empty_documents(spark, stage):
    assert stage[1](spark, no_documents(spark), FOLDER).count() == 0
    out = stage[1](spark, odd_documents(spark), FOLDER)
    assert out.count() > 0
    if stage[0] != "packing":
        assert out.columns == odd_documents(spark).columns


def test_queries_with_sql_agree(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    for name, text in queries.ORACLES.items():
        assert compare(queries.QUERIES[name](spark, FOLDER), con, text) is None, name


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "packing"]
