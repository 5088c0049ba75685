"""Exact dedup on an extendible-hash index in shared files, with DataFrame operations only.

Keys are 64-bit hashes of the normalised text (white space deleted). The index is built in four steps:

1. Entries: one narrow row per document (id, key, code points, digest), and per key a count, pre-aggregated
   before the shuffle, so that a group that holds a third of all rows is one entry.
2. Directory: buckets are ranges of keys that share their first `depth` bits. It is laid out for the number of keys,
   2 ** depth buckets of `capacity` at most on average. A bucket with more than `capacity` keys is overfull and the
   directory doubles: the bucket is split by one more bit, until none is overfull or `max_depth` is reached (a bucket
   of that depth keeps its overflow, which is exact too). A step regroups only the keys of overfull buckets; hashes
   are even, so one or two steps do at any size.
3. Bucket files: entries are dealt to owner tasks by bucket, so that a task owns whole buckets, one range of keys, and are
   written in key order.
4. Chains: only keys with two rows or more can hold copies or collisions. Their texts are read again, take the bucket
   of their key from the index, and are grouped inside it by key and text: a key's distinct texts are its chain, told
   apart by their bytes, each with its copies' count and its best row. Rows meet their chain link by an equi-join on bucket, key and
   bytes. Texts move once, in a sort-merge join at every size, which adaptive execution can split where one key is hot;
   what it keeps is written to shared files, with a number for each row.

Defined results: a null text is empty; texts that are only white space equal the empty one; of equal texts the
row with the most code points in the original text stays, then the smallest doc_id (a null id last); repeated rows are rows
like others: where the best row occurs several times with the same doc_id, one of its occurrences stays, so each group
keeps exactly one row; no rows give no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.session import shared_path, stored

#: Keys in a bucket before it splits, and the directory's largest depth.
CAPACITY = 1 << 14
MAX_DEPTH = 32
#: The characters 20 and 09-0D.
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n"),
        normalised(text).alias("norm"),
        F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(text, F.lit(""))).alias("row_key"),
    ).withColumn("key", F.xxhash64("norm"))


def _prefix(depth: int) -> Column:
    """The first `depth` bits of the key; 0 at depth 0."""
    return F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - depth)) if depth else F.lit(0).cast("long")


def _first_key(depth: str) -> Column:
    """The key with which the bucket of a key begins."""
    unused = F.lit(64) - F.col(depth)
    return F.when(F.col(depth) == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("key"), unused), unused))


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, first_depth: int | None = None) -> dict[int, DataFrame]:
    """Tables (depth, prefix, keys) of the final buckets of the (key) table, by depth; a job per doubling."""
    if first_depth is None:
        first_depth = min(max_depth, max(0, math.ceil(math.log2(max(1, keys.count()) / capacity))))
    tables, left = {}, keys.select("key")
    for depth in range(first_depth, max_depth + 1):
        sums = left.groupBy(_prefix(depth).alias("prefix")).agg(F.count("*").alias("keys"))
        level = stored(sums.select(F.lit(depth).alias("depth"), "prefix", "keys"), "directory")
        over = F.col("keys") > (capacity if depth < max_depth else 2**62)
        tables[depth] = level.filter(~over)
        overfull = level.filter(over).select("prefix")
        if overfull.isEmpty():
            break
        left = stored(left.withColumn("prefix", _prefix(depth)).join(overfull, "prefix", "left_semi").select("key"), "overfull")
    return tables


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One narrow row per document, and the index's bucket files: (depth, prefix, key, copies, bucket), one entry per key, in key order."""
    spark = docs.sparkSession
    rows = stored(_keyed(docs).select("doc_id", "n", "key", "row_key", F.sha2("norm", 256).alias("text_sha256")), "rows")
    counts = stored(rows.groupBy("key").agg(F.count("*").alias("copies")), "keys")
    entries = [
        counts.withColumn("prefix", _prefix(depth)).join(buckets.select("depth", "prefix"), "prefix").select("depth", "prefix", "key", "copies")
        for depth, buckets in directory(counts, capacity, max_depth).items()
    ]
    owned = reduce(DataFrame.unionByName, entries).withColumn("bucket", _first_key("depth"))
    path = path or shared_path(spark, "index")
    owned.repartitionByRange("bucket").sortWithinPartitions("bucket", "key").write.parquet(path)
    return rows, spark.read.schema(owned.schema).parquet(path)


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row_key (a hash of doc_id and the text as it is) of every row of (doc_id, text)."""
    rows, index = build_index(docs, capacity, max_depth)
    several = index.filter(F.col("copies") > 1).select("bucket", "key")
    alone = rows.join(several, "key", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "row_key")
    again = stored(_keyed(docs).join(several.hint("merge"), "key").withColumn("row", F.monotonically_increasing_id()), "several")
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    chains = stored(again.groupBy("bucket", "key", "norm").agg(F.count("*").alias("group_size"), F.min(order).alias("best")), "chains")
    same = again.join(chains, ["bucket", "key", "norm"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.sha2("norm", 256).alias("text_sha256"),
        "row_key",
    )
    return alone.unionByName(same)
