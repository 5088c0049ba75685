"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Decisions take effect: rejected rows are gone.

Each filter knows rows by a hash of doc_id and text, so that a decision hits the rows it is about: rows that share a doc_id and
rows without one are told apart, and of rows that are equal in both, one stays where one is to stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import decontamination, exact_dedup, near_join, packing, quality
from twinfold.session import ship, shared_path, stored


def _labelled_for_training() -> Column:
    """Labels of documents whose crc32(doc_id as text) mod 4 is 2 stay unseen."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _decided(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs after verdicts (key, stays): of rows with a key that stays, one stays; others without a verdict all stay.

    A sort-merge join at every size: lists of keys grow with the corpus. The rows move once."""
    key, stays, one = (_free(docs, name) for name in ("_key", "_stays", "_one"))
    named = verdicts.select(F.col("key").alias(key), F.col("stays").alias(stays)).hint("merge")
    left = docs.withColumn(key, _row_key()).join(named, key, "left").filter(F.coalesce(stays, F.lit(True)))
    numbered = left.withColumn(one, F.when(F.col(stays).isNull(), F.monotonically_increasing_id()).otherwise(-1))
    return numbered.dropDuplicates([key, one]).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _labelled_for_training())
    score = _free(docs, "_quality")
    return quality.score(docs, model, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts."""
    grouped = exact_dedup.exact_dedup(docs).filter("group_size > 1")
    return _decided(docs, grouped.groupBy(F.col("row_key").alias("key")).agg(F.max("kept").alias("stays")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates: documents that links connect, so one that goes
    may be near others of its group only."""
    names = docs.select(_row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    linked = stored(near_join.near_classes(names.select(F.col("key").alias("doc_id"), "text")).filter("n_links > 0").select(F.col("doc_id").alias("key"), "class_id").distinct(), "linked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))
    kept = names.select("key", "doc_id").join(linked, "key").groupBy("class_id").agg(least["key"].alias("kept"))
    return _decided(docs, linked.join(kept, "class_id").select("key", (F.col("key") == F.col("kept")).alias("stays")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(docs.select(_row_key().alias("doc_id"), "text"), items).filter(F.size("spans") > 0)
    return _decided(docs, found.select(F.col("doc_id").alias("key"), F.lit(False).alias("stays")).distinct())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, window=4096)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Compression scores, MinHash candidates and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
