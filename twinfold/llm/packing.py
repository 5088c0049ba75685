"""Lexical retrieval packing: BM25 neighbours greedily fill each seed document's window.

The terms are the ids that are packed, so the statistics (document frequencies and mean length, counted over all
documents) have the size of the vocabulary, which is what is broadcast. The index is sharded by topic:

1. Documents are encoded once, into shared files of blocks.
2. Each document gets a topic path: of its ids that occur in more than 1/FAN of all documents the one of the largest
   BM25 weight, then of those in more than 1/FAN**2, and so on down to ids that two documents share. Range
   partitioning and running sums put all documents in the order of their paths, and a shard is the run of documents that
   starts in the same `shard_tokens` ids of that order. Documents of a topic are neighbours in it, wherever they were
   read; the number of shards grows with the corpus, and a task's work does not.
3. A shard is an inverted index with corpus-wide weights. Its windows are filled one after the other. The seed of a
   window is the rest of the document that the last window cut, or else the first unused document. All its ids are the query,
   and the unused documents of the shard with the highest BM25 sums follow it, best first, then unused documents in
   order when no more share an id. Windows are full but for a shard's last, which is cut at powers of two, so there is no padding.

A seed's neighbours are those of its own topic range, not of the whole corpus: looking each seed up in all postings takes
work that grows with the square of the corpus. Within the shard, retrieval is exact: no query term, posting
or neighbour is left out. Paths, shards and weights are functions of the documents alone, so that partitions, batches and the
order of rows change nothing. Weights are whole units of 2^-16, so that sums are exact in any order.

Defined results: ties go to the earlier document in topic order, then of the smaller hash of doc_id and text; a null or empty
text is the end id alone; every row is packed, repeated rows and null doc_ids too; a text of any length lies in one
shard and is cut over as many windows as it needs; sequence_id is the number of ids before the shard plus the sequence's
place in it; no rows give no pieces; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.bpe import CACHE_UNITS, encoder, forget_encoders, with_end
from twinfold.llm.words import slices
from twinfold.session import stored

#: Text bytes of a block of encoded documents, and ids of a shard.
BLOCK_BYTES = 4 << 20
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
UNIT = 1 << 16
#: How much rarer the ids of a path's next level are.
FAN = 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Statistics(NamedTuple):
    """Of all documents: their number, their mean length, and how many hold each id; ends are not counted."""

    docs: int
    mean: float
    df: np.ndarray

    def weights(self, token: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25 weights, in units, of ids that occur `count` times in documents of the given length."""
        idf = np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5))
        scale = K1 * (1 - B + B * length / max(1.0, self.mean))
        return np.rint(idf[token] * count * (K1 + 1) / (count + scale) * UNIT).astype(np.int64)

    def bands(self) -> list[tuple[int, int]]:
        """(low, high) of each level of a path: ids of more than low and at most high documents."""
        out, high = [], self.docs
        while high >= 2:
            out.append((max(1, high // FAN), high))
            high //= FAN
        return out or [(1, 1)]


def term_counts(ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, occurrences), by document, then id, of sequences that each close with an end, which is not counted."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(sizes) - 1] = False
    pairs, counts = np.unique(doc[inner] * vocabulary + ids[inner], return_counts=True)
    return *np.divmod(pairs, vocabulary), counts


def topic_paths(doc: np.ndarray, token: np.ndarray, weight: np.ndarray, n: int, known: Statistics) -> np.ndarray:
    """A row a document: for each level the id of the largest weight plus one (ties: the smaller id), or 0."""
    bands, vocabulary = known.bands(), len(known.df)
    out = np.zeros((n, len(bands)), ">u4")
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
    value, df = weight * vocabulary + (vocabulary - 1 - token), known.df[token]
    for level, (low, high) in enumerate(bands):
        if len(heads):
            best = np.maximum.reduceat(np.where((df > low) & (df <= high), value, -1), heads)
            out[doc[heads], level] = np.where(best >= 0, vocabulary - best % vocabulary, 0)
    return out


class Bm25Shard:
    """An inverted index over (document, id, weight) postings in order of document: for each id the documents that hold it."""

    def __init__(self, doc: np.ndarray, token: np.ndarray, weight: np.ndarray, n: int, vocabulary: int) -> None:
        self.n, self.edges, self.terms = n, np.searchsorted(doc, np.arange(n + 1)), token
        self.vocabulary, self.rows, self.weight = vocabulary, doc, weight
        self.build(np.ones(n, bool))

    def build(self, unused: np.ndarray) -> None:
        """Postings of the unused documents only."""
        held = np.flatnonzero(unused[self.rows])
        held = held[np.argsort(self.terms[held], kind="stable")]
        self.posted, self.posted_weight = self.rows[held], self.weight[held].astype(np.float64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.terms[held], minlength=self.vocabulary))])
        self.live = int(unused.sum())

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share an id with the seed, by their BM25 sums for all its ids, best first, ties in order."""
        if 2 * int(unused.sum()) < self.live:
            self.build(unused)
        terms = self.terms[self.edges[seed] : self.edges[seed + 1]]
        first, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        to = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(first - to[:-1], size) + np.arange(to[-1])
        score = np.bincount(self.posted[at], self.posted_weight[at], self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Fills windows with pieces (document, start, length, sequence, offset)."""

    def __init__(self, sizes: np.ndarray, window: int) -> None:
        self.sizes, self.window = sizes.tolist(), window
        self.unused = np.ones(len(sizes), bool)
        self.pieces: list[tuple[int, int, int, int, int]] = []
        self.filled = self.sequence = 0
        self.rest: tuple[int, int] | None = None

    def place(self, doc: int, start: int) -> bool:
        """Put the document from `start` on into the open window; whether that is full now."""
        self.unused[doc] = False
        length = min(self.window - self.filled, self.sizes[doc] - start)
        self.pieces.append((doc, start, length, self.sequence, self.filled))
        self.filled += length
        self.rest = (doc, start + length) if start + length < self.sizes[doc] else None
        if self.filled < self.window:
            return False
        self.filled, self.sequence = 0, self.sequence + 1
        return True

    def run(self, index: Bm25Shard) -> list[tuple[int, int, int, int, int]]:
        head = 0  # all documents before it are used

        def next_unused() -> int | None:
            nonlocal head
            while head < len(self.sizes) and not self.unused[head]:
                head += 1
            return head if head < len(self.sizes) else None

        while self.rest is not None or next_unused() is not None:
            seed, start = self.rest or (head, 0)
            full = self.place(seed, start)
            if not full and next_unused() is not None:
                full = any(self.place(doc, 0) for doc in index.neighbours(seed, self.unused).tolist())
            while not full and (doc := next_unused()) is not None:
                full = self.place(doc, 0)
        self.cut_last()
        return self.pieces

    def cut_last(self) -> None:
        """Cut the open window into sequences of ever smaller powers of two."""
        left, last = self.filled, self.sequence
        opened = [p for p in self.pieces[-self.window :] if p[3] == last]
        del self.pieces[len(self.pieces) - len(opened) :]
        at, room = 0, 1 << (left.bit_length() - 1) if left else 0
        for doc, start, length, _, _ in opened:
            while length:
                take = min(length, room - at)
                self.pieces.append((doc, start, take, self.sequence, at))
                start, length, at = start + take, length - take, at + take
                if at == room:
                    left -= room
                    self.sequence, at, room = self.sequence + 1, 0, 1 << (left.bit_length() - 1) if left else 0


BLOCKS = "part int, slot int, doc_ids array<long>, keys binary, sizes binary, ids binary, tokens array<int>, df array<int>, lengths long"
TOPICS = "part int, slot int, place int, key long, size long, path binary"


def _binary(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([values.astype(kind).tobytes()], pa.binary())


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, block_bytes: int, cache_units: int, kind: str, size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    coder = encoder(vocabulary, False, cache_units)
    for slot, block in enumerate(slices(batches, "text", block_bytes)):
        ids, bounds = with_end(*coder.encode(block.column(1)), end)
        sizes = np.diff(bounds)
        df = np.bincount(term_counts(ids, sizes, size)[1], minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([slot], pa.int32()),
                _listed(pa.concat_arrays([block.column(0)])),
                _binary(block.column(2).to_numpy(), "<i8"),
                _binary(sizes, "<i8"),
                _binary(ids, kind),
                _listed(pa.array(held.astype(np.int32))),
                _listed(pa.array(df[held].astype(np.int32))),
                pa.array([len(ids) - len(sizes)]),
            ],
            names=["part", "slot", "doc_ids", "keys", "sizes", "ids", "tokens", "df", "lengths"],
        )


def _opened(batch: pa.RecordBatch, k: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """sizes, ids of row k of a batch of blocks."""
    return np.frombuffer(batch.column("sizes")[k].as_buffer(), "<i8"), np.frombuffer(batch.column("ids")[k].as_buffer(), kind)


def _topics(batches: Iterator[pa.RecordBatch], held: object, kind: str) -> Iterator[pa.RecordBatch]:
    forget_encoders()
    known = held.value
    for batch in batches:
        for k in range(batch.num_rows):
            sizes, ids = _opened(batch, k, kind)
            n = len(sizes)
            doc, token, count = term_counts(ids, sizes, len(known.df))
            paths = topic_paths(doc, token, known.weights(token, count, sizes[doc] - 1), n, known)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, batch.column("part")[k].as_py(), np.int32)),
                    pa.array(np.full(n, batch.column("slot")[k].as_py(), np.int32)),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(np.frombuffer(batch.column("keys")[k].as_buffer(), "<i8")),
                    pa.array(sizes),
                    pa.array([p.tobytes() for p in paths], pa.binary()),
                ],
                names=["part", "slot", "place", "key", "size", "path"],
            )


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number and the ids before each document in it."""
    from pyspark import TaskContext

    number, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = total + np.cumsum(batch.column("size").to_numpy())
        start = np.concatenate([[total], ends])[: batch.num_rows]
        total = int(ends[-1]) if len(ends) else total
        columns = [batch.column(c) for c in ("part", "slot", "place", "size")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(start, pa.int64())], names=["part", "slot", "place", "size", "range", "start"])


def _spread(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """One row a document, with its place in topic order."""
    step = np.dtype(kind).itemsize
    for batch in batches:
        for k in range(batch.num_rows):
            sizes, ids = _opened(batch, k, kind)
            found = batch.column("found")[k].values
            order = np.argsort(found.field(0).to_numpy())
            edges = np.concatenate([[0], np.cumsum(sizes * step)])
            own = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids)])
            start = found.field(1).to_numpy()[order]
            shard = found.field(2).to_numpy()[order]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(start), batch.column("doc_ids")[k].values, own.cast(pa.binary())], names=["shard", "start", "doc_id", "ids"])


def _packed(table: pa.Table, held: object, window: int, kind: str) -> pa.Table:
    known = held.value
    table = table.sort_by("start")
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), kind)
    sizes = pc.binary_length(table.column("ids")).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
    doc, token, count = term_counts(ids, sizes, len(known.df))
    index = Bm25Shard(doc, token, known.weights(token, count, sizes[doc] - 1), len(sizes), len(known.df))
    pieces = Packer(sizes, window).run(index)
    doc, start, length, sequence, offset = np.array(pieces, np.int64).reshape(-1, 5).T
    raw = memoryview(ids.astype("<u4").tobytes())
    first = np.concatenate([[0], np.cumsum(sizes)])[doc] + start
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
    before = table.column("start")[0].as_py()
    columns = [table.column("doc_id").take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), sizes[doc], before + sequence, offset))]
    return pa.table(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def statistics(blocks: DataFrame, size: int) -> Statistics:
    """From one row a block and one an id: sums that the vocabulary bounds."""
    docs, lengths = blocks.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)), F.coalesce(F.sum("lengths"), F.lit(0))).first()
    each = blocks.select(F.explode(F.arrays_zip("tokens", "df")).alias("x")).groupBy("x.tokens").agg(F.sum("x.df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[each.column(0).to_numpy()] = each.column(1).to_numpy()
    return Statistics(docs, lengths / max(1, docs), df)


def topic_order(blocks: DataFrame, held: object, kind: str, shard_tokens: int) -> DataFrame:
    """(part, slot, found): for each document of a block its place, the ids before it in topic order, and its shard."""
    spark = blocks.sparkSession
    topics = stored(blocks.select("part", "slot", "keys", "sizes", "ids").mapInArrow(lambda it: _topics(it, held, kind), TOPICS), "topics")
    order = ["path", "key", "part", "slot", "place"]
    ranges = stored(topics.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_before, "part int, slot int, place int, size long, range int, start long"), "order")
    bases, total = [], 0
    for row in ranges.groupBy("range").agg(F.sum("size").alias("size")).orderBy("range").collect():  # one row a range
        bases.append((row["range"], total))
        total += row["size"]
    base = spark.createDataFrame(bases, "range int, base long")
    start = F.col("base") + F.col("start")
    found = F.struct("place", start.alias("start"), F.floor(start / shard_tokens).cast("long").alias("shard"))
    return ranges.join(base, "range").groupBy("part", "slot").agg(F.collect_list(found).alias("found"))  # a block holds few documents


def pack(
    docs: DataFrame,
    vocabulary: str,
    end: int = 2,
    window: int = 4096,
    block_bytes: int = BLOCK_BYTES,
    shard_tokens: int = SHARD_TOKENS,
    cache_units: int = CACHE_UNITS,
) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most `window` ids (a power of two); one row per piece."""
    from tokenizers import Tokenizer

    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    size = max(end, *Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values()) + 1
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    blocks = stored(rows.mapInArrow(lambda it: _encode(it, vocabulary, end, block_bytes, cache_units, kind, size), BLOCKS), "blocks")
    held = spark.sparkContext.broadcast(statistics(blocks, size))
    found = topic_order(blocks, held, kind, shard_tokens)
    placed = blocks.select("part", "slot", "doc_ids", "sizes", "ids").join(found, ["part", "slot"])
    spread = placed.mapInArrow(lambda it: _spread(it, kind), "shard long, start long, doc_id long, ids binary")
    return spread.groupBy("shard").applyInArrow(lambda t: _packed(t, held, window, kind), PIECES)
