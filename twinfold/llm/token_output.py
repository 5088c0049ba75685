"""Token-ID output in ORC: integer run lengths, row indexes, Bloom filters on document ids, stripe-parallel reads.

write_tokens() range-partitions whole texts by doc_id, sorts each range and encodes it into ORC in the same
stage, so what is shuffled is text and never ids. Each file is one range: file k holds smaller ids than file
k + 1. Beside its ids a row carries `part` and `part_offset` (ids before it in its part), so global starts need
only one sum per part. read_tokens() is Spark's own ORC scan: one task per group of stripes, columns pruned;
find_documents() pushes an id predicate down to stripe statistics, row indexes and Bloom filters.

Defined results: a null text is empty and has only the end id; a null doc_id sorts first; rows with the same
doc_id are ordered by text; every row is written, repeated ones too; no rows give no files and an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.bpe import CACHE_UNITS, encoder, with_end
from twinfold.llm.words import lists, slices
from twinfold.session import shared_path

#: Bytes of text encoded at once.
BLOCK_BYTES = 4 << 20
FILE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_offset", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, cache_units: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    coder = encoder(vocabulary, True, cache_units)
    for block in slices(batches, "text", BLOCK_BYTES):
        ids, bounds = with_end(*coder.encode(block.column(1)), end)
        n = block.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                block.column(0),
                pa.array(np.full(n, part, np.int32)),
                pa.array(before + bounds[:-1]),
                pa.array(np.diff(bounds)),
                lists(ids.astype(np.int32), bounds, pa.int32()),
            ],
            names=FILE_SCHEMA.names,
        )
        before += int(bounds[-1])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = 0, cache_units: int = CACHE_UNITS) -> None:
    """Encode (doc_id, text) with the byte-level vocabulary file and write ORC files in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = ordered.mapInArrow(lambda it: _encode(it, vocabulary, end, cache_units), FILE_SCHEMA)
    coded.write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a stated list of ids; ORC metadata prunes stripes and row groups."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(4)
        bounds = column.offsets.to_numpy()
        ids = memoryview(column.values.to_numpy().astype("<u4")).cast("B")
        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], names=["doc_id", "part", "part_offset", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of files read back.

    The sums per part are one row per file; they are joined as a table, which Spark broadcasts only if it is small.
    """
    each = tokens.mapInArrow(_digest, "doc_id long, part int, part_offset long, n_tokens long, ids_crc32 long")
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("size")).orderBy("part").collect()  # one row per file
    bases, total = [], 0
    for row in sums:
        bases.append((row["part"], total))
        total += row["size"]
    spark = tokens.sparkSession
    base = spark.createDataFrame(bases, "part int, base long")
    return each.join(base, "part").select("doc_id", (F.col("base") + F.col("part_offset")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, vocabulary: str, end: int = 0, path: str | None = None) -> DataFrame:
    """Write docs' ids as ORC (to `path`, or a new folder in the shared one), read the files back and digest them."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end)
    return digest(read_tokens(spark, path))
