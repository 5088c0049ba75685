"""Benchmark decontamination on a distributed positional inverted index.

build_index() reads (doc_id, text) once and writes the index to shared files, document-sharded: a shard is a run of
whole documents of at most `shard_bytes` of text (one document at least), held as one row with its vocabulary, the
posting list of every word (sorted word positions, as differences) and its documents' places. Shards are cut where
rows are read, so building shuffles nothing and no word, source or document meets another task's.

search() takes item windows in blocks of a checked size, each broadcast to all shards. In a shard all windows are
answered together: windows that lack a word there are out; each window starts from the list of its rarest word,
moved by the word's place in the window, and is intersected with the other lists from rare to common. What is left
are exact phrase matches. For proximity matches an occurrence of the rarest word stays as long as every other word
of the window occurs within `slop` words of it in the same document. A document's matches are all found in its own
shard; matches of several blocks are merged by (shard, row).

Defined results: words are those of words.ALNUM; an item with fewer words than a window, but not none, is one
window; null texts have no words; items without words never match; rows of items with the same id count as one
item; items with a null id mark words as hit but are in no list; every row of docs gives one row, repeated ones
and null doc_ids too; no rows give no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.words import ALNUM, lists, slices, split_words
from twinfold.session import stored

SHARD_BYTES = 8 << 20
WINDOW = 10
SLOP = 16
#: Windows in a block that is broadcast; of ten words each that is at most some 10 MB.
BLOCK_WINDOWS = 100_000

INDEX = "shard string, doc_ids array<long>, firsts array<int>, sizes array<int>, words array<string>, list_ends array<int>, gaps binary"
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
MATCHES = T.StructType(
    [
        T.StructField("shard", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", _SPAN),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("near_items", T.ArrayType(T.StringType())),
    ]
)


def _index(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, block in enumerate(slices(batches, "text", shard_bytes)):
        codes, bounds, words = split_words(block.column(1), ALNUM)
        sizes = np.diff(bounds)
        firsts = bounds[:-1] + np.arange(len(sizes))  # one place stays free between documents, so no phrase spans two
        places = np.arange(len(codes), dtype=np.int64) + np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(codes, kind="stable")
        gaps = np.diff(places[order], prepend=0).astype("<i4")  # falls where a new list begins
        ends = np.cumsum(np.bincount(codes, minlength=len(words)))
        one = np.array([0, len(sizes)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{part}-{k}"]),
                pa.ListArray.from_arrays(pa.array(one, pa.int32()), pa.concat_arrays([block.column(0)])),
                lists(firsts, one, pa.int32()),
                lists(sizes, one, pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.large_string()).cast(pa.string())),
                lists(ends, [0, len(words)], pa.int32()),
                pa.array([gaps.tobytes()], pa.binary()),
            ],
            names=["shard", "doc_ids", "firsts", "sizes", "words", "list_ends", "gaps"],
        )


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of (doc_id, text), written to the shared folder; one row per shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(lambda it: _index(it, shard_bytes), INDEX), "postings")


def window_blocks(items: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> Iterator[tuple[list[str], np.ndarray, list[str | None], np.ndarray]]:
    """(words, windows, item ids, item of each window): distinct windows of (item_id, text), `block` at most at a time.

    Rows of windows are word numbers, -1 beyond the end of a short item. Items come one by one to the driver."""
    numbers: dict[str, int] = {}
    windows: dict[tuple[int, ...], list[int]] = {}
    ids: list[str | None] = []
    places: dict[str | None, int] = {}

    def full() -> tuple:
        table = np.full((len(windows), window), -1, np.int64)
        for i, w in enumerate(windows):
            table[i, : len(w)] = w
        pairs = np.array([(i, k) for i, own in enumerate(windows.values()) for k in sorted(set(own))], np.int64).reshape(-1, 2)
        return list(numbers), table, list(ids), pairs

    for row in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        codes, _, vocabulary = split_words(pa.array([row["text"]], pa.string()), ALNUM)
        names = [w.decode() for w in vocabulary.to_pylist()]
        own = [names[c] for c in codes.tolist()]
        for at in range(max(1, len(own) - window + 1) if own else 0):
            k = places.setdefault(row["item_id"], len(ids))
            if k == len(ids):
                ids.append(row["item_id"])
            windows.setdefault(tuple(numbers.setdefault(w, len(numbers)) for w in own[at : at + window]), []).append(k)
            if len(windows) == block:
                yield full()
                for held in (numbers, windows, ids, places):
                    held.clear()
    if windows:
        yield full()


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    to = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(first - to[:-1], size) + np.arange(to[-1])


def match_shard(words: pa.Array, ends: np.ndarray, places: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, query: list[str], windows: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
    """(window, place) of exact matches and (window, place of its rarest word) of proximity matches in a shard."""
    row = pc.index_in(pa.array([*query, ""], pa.string()), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row[-1] = -2  # a place beyond a short item's end
    table = row[windows]
    here = np.flatnonzero((table != -1).all(1))
    table = table[here]
    first = np.concatenate([[0], ends]).astype(np.int64)
    df = np.where(table >= 0, first[table + 1] - first[table], np.iinfo(np.int64).max)
    rank = np.argsort(df, axis=1, kind="stable")
    lead = rank[:, 0]
    each = np.arange(len(table))
    size = df[each, lead] if len(table) else np.zeros(0, np.int64)
    at = _ranges(first[table[each, lead]], size)
    window = np.repeat(each, size)
    place = places[at]
    keys = np.repeat(np.arange(len(ends)), np.diff(first)) << 32 | places  # ascending: lists by word, places within

    def has(word: np.ndarray, where: np.ndarray) -> np.ndarray:
        key = word << 32 | where
        found = np.searchsorted(keys, key)
        return keys[np.minimum(found, len(keys) - 1)] == key

    exact_w, exact_p = window, place - lead[window]
    near_w, near_p = window, place
    doc = np.searchsorted(firsts, near_p, "right") - 1
    low, high = np.maximum(near_p - slop, firsts[doc]), np.minimum(near_p + slop, firsts[doc] + sizes[doc] - 1)
    for k in range(1, table.shape[1]):
        column = rank[exact_w, k]
        word = table[exact_w, column]
        where = exact_p + column
        keep = (word < 0) | ((where >= 0) & has(word, np.maximum(where, 0)))
        exact_w, exact_p = exact_w[keep], exact_p[keep]
        word = table[near_w, rank[near_w, k]]
        found = np.searchsorted(keys, np.maximum(word, 0) << 32 | low)
        keep = (word < 0) | (keys[np.minimum(found, len(keys) - 1)] <= (word << 32 | high)) & (found < len(keys))
        near_w, near_p, low, high = near_w[keep], near_p[keep], low[keep], high[keep]
    return here[exact_w], exact_p, here[near_w], near_p


def _listed(rows: np.ndarray, items: np.ndarray, n: int, ids: list[str | None]) -> pa.Array:
    """For each of n rows the distinct ids of its items, nulls left out."""
    known = np.array([i is not None for i in ids] + [False])
    keep = known[items]
    pairs = np.unique(rows[keep] * max(1, len(ids)) + items[keep])
    own, item = np.divmod(pairs, max(1, len(ids)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), pa.array(ids, pa.string()).take(pa.array(item)))


def _search(batches: Iterator[pa.RecordBatch], block, slop: int) -> Iterator[pa.RecordBatch]:
    query, windows, ids, pairs = block.value
    lengths = (windows >= 0).sum(1)
    of = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))

    def items(window: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
        seen = np.unique(rows * len(windows) + window)
        rows, window = np.divmod(seen, len(windows))
        size = of[window + 1] - of[window]
        return _listed(np.repeat(rows, size), pairs[_ranges(of[window], size), 1], n, ids)

    for batch in batches:
        for k in range(batch.num_rows):
            shard, doc_ids, firsts, sizes, words, ends, gaps = (batch.column(i)[k] for i in range(7))
            firsts, sizes, ends = (x.values.to_numpy().astype(np.int64) for x in (firsts, sizes, ends))
            n = len(sizes)
            places = np.cumsum(np.frombuffer(gaps.as_py(), "<i4"), dtype=np.int64)
            if len(places):
                window, place, near, near_place = match_shard(words.values, ends, places, firsts, sizes, query, windows, slop)
            else:
                window = place = near = near_place = np.zeros(0, np.int64)
            row = np.searchsorted(firsts, place, "right") - 1
            change = np.zeros(int(firsts[-1] + sizes[-1]) + 2, np.int32)
            np.add.at(change, place, 1)
            np.add.at(change, place + lengths[window], -1)
            edge = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            own = np.searchsorted(firsts, start, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(start - firsts[own], pa.int32()), pa.array(end - firsts[own], pa.int32())], names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard.as_py()] * n),
                    pa.array(np.arange(n, dtype=np.int32)),
                    doc_ids.values,
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), spans),
                    items(window, row, n),
                    items(near, np.searchsorted(firsts, near_place, "right") - 1, n),
                ],
                names=MATCHES.names,
            )


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """shard, row, doc_id, n_words, spans (word ranges hit, disjoint), items and near_items (ids with exact and proximity matches) of every indexed row."""
    spark = index.sparkSession
    found = None
    count = 0
    for block in window_blocks(items, window, block_windows):
        held = spark.sparkContext.broadcast(block)
        own = index.mapInArrow(lambda it, held=held: _search(it, held, slop), MATCHES)
        found = own if found is None else found.unionByName(own)
        count += 1
    if found is None:
        empty = F.array().cast("array<string>")
        each = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("row", "x"))
        return each.select("shard", "row", F.col("x.doc_ids").alias("doc_id"), F.col("x.sizes").cast("long").alias("n_words"), F.array().cast(_SPAN).alias("spans"), empty.alias("items"), empty.alias("near_items"))
    if count == 1:
        return found
    return found.groupBy("shard", "row", "doc_id", "n_words").agg(
        *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("spans", "items", "near_items"))
    )


def hits(spans: str = "spans") -> Column:
    """The number of words that sorted spans cover together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["e"]))).alias("n"), F.greatest(a["e"], x["end"]).alias("e")),
        lambda a: a["n"].cast("long"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, shard_bytes: int = SHARD_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Index docs and search all items: the matches of every row of docs."""
    return search(build_index(docs, shard_bytes), items, window, slop, block_windows)
