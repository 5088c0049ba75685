"""The test tables as inventories: what both engines can derive from documents and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCES = ("src1", "src4", "src8", "src13")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with names of one made-up physical file for some documents of equal content."""
    docs = documents(spark, sf_dir)
    base = docs.select(
        "doc_id",
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") * 1000).alias("mtime_ns"),
        F.when(F.col("source").isin("src0", "src1", "src2"), 1).otherwise(2).cast("long").alias("dev"),
        F.col("source").isin(*REFERENCES).alias("is_ref"),
        (F.col("doc_id") % 5 == 0).alias("compressed"),
        (F.col("doc_id") % 11 == 0).alias("read_only"),
        F.sha2("text", 256).alias("sha256"),
        (F.col("doc_id") % 2).alias("parity"),
    )
    keys = ["dev", "sha256", "parity"]
    linked = base.groupBy(*keys).agg((F.min("doc_id") + 1).alias("inode"), F.count("*").alias("num_links"))
    return base.join(linked, keys).select("doc_id", "path", "size", "mtime_ns", "dev", "inode", "num_links", "is_ref", "sha256", "compressed", "read_only")


def live_state(rows: DataFrame) -> DataFrame:
    """A later look at the inventory: some files gone, some touched, some no regular files."""
    gone, touched, other = F.col("doc_id") % 17 == 0, F.col("doc_id") % 13 == 0, F.col("doc_id") % 29 == 0
    return rows.select(
        "path", (~gone).alias("exists"), (~other).alias("is_regular"), "size", (F.col("mtime_ns") + F.when(touched, 3600).otherwise(0)).alias("mtime_ns"), "dev", "inode", "read_only"
    )


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as extents: a group per supplier, eight members, places by part."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.col("l_suppkey").alias("grp"),
        (F.col("l_orderkey") % 8).alias("member"),
        (F.col("l_suppkey") % 3).cast("long").alias("dev"),
        F.col("l_linenumber").cast("long").alias("logical"),
        (F.col("l_partkey") + 1).alias("physical"),
        F.col("l_quantity").cast("long").alias("length"),
        (F.col("l_linenumber") % 3 == 0).alias("shared"),
        (F.col("l_linenumber") == 5).alias("encoded"),
        (F.col("l_linenumber") == 6).alias("opaque"),
    )
