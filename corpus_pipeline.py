"""The corpus pipeline: from documents to packed training sequences.

Every stage takes (spark, docs, folder) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of the documents they get.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import jaccard_join, langid, packing, resampling, secrets
from halyard.sources.scratch import drop_written, written

LEAST_LANGUAGE_SCORE = 0.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labelled ones keeps.

    Rows are told apart by id and text: a text stays or goes whatever other texts share its id, null being an id.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    numbered = docs.withColumn("halyard_row", F.xxhash64("doc_id", "text"))
    target = numbered.select("halyard_row", "doc_id").join(labels.select(F.col("doc_id").alias("halyard_id")), F.col("doc_id") == F.col("halyard_id"), "left_semi")
    sampled = resampling.resample(numbered, "halyard_row", "text", target.select(F.col("halyard_row").alias("id")).distinct())
    kept = sampled.where("kept").select(F.col("id").alias("halyard_kept")).distinct()
    return numbered.join(kept, F.col("halyard_row") == F.col("halyard_kept"), "left_semi").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; one without a language gets the one found.

    If no document with a letter has a language, there is nothing to tell by: all with a letter stay as they are.
    """
    learned = langid.learn(docs, "text", "lang")
    if not learned:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, "text", learned, language="halyard_language", score="halyard_score")
    told = (F.col("halyard_language") != langid.UNKNOWN) & (F.col("halyard_score") >= LEAST_LANGUAGE_SCORE)
    return found.where(told).withColumn("lang", F.coalesce("lang", "halyard_language")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of similarity 0.8 or more."""
    # rows are told apart by id and text: ids may be null or repeated; only a row that is a full repetition shares its number
    numbered = docs.withColumn("halyard_row", F.xxhash64("doc_id", "text"))
    groups = jaccard_join.linked(numbered, "halyard_row", "text", width=5, num=80, den=100).select("id", "component_id").distinct()
    ids = numbered.select("halyard_row", "doc_id").distinct()
    placed = groups.join(ids, groups["id"] == ids["halyard_row"])
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "halyard_row")).alias("first")
    kept = placed.groupBy("component_id").agg(first).select(F.col("first.halyard_row").alias("halyard_row"))
    return numbered.join(kept, "halyard_row", "left_semi").dropDuplicates(["halyard_row", "doc_id", "text"]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    found = secrets.find(docs, "text", secrets.train(docs, "text"))
    clean = secrets.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", clean).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences: one row a piece, with its token ids."""
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=2, literal=True)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: Trained models, component search and tokenizing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents under a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return docs
