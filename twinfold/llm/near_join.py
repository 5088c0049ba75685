"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

1. Signatures. Each text becomes the set of its runs of `n` words (fewer words: one run of them all), as 64-bit
   hashes. Texts with equal sets are one class and go on as one row; the rest of the work is over classes.
   choose_bands() picks band and row counts for the target recall at the threshold.
2. Shuffle on band hashes. A bucket links its classes to its least one, so a bucket of any size gives one edge a
   class, from a pre-aggregated minimum. components() joins buckets that share classes into candidate groups.
3. Verification. All pairs inside a candidate group are counted on the full sets, not only those that met in a
   band. A group is cut into blocks of about `BLOCK` classes and `BLOCK_GRAMS` n-grams, and a task counts one pair of
   blocks: n-grams that many classes hold by a matrix product, others by their posting lists. A task returns one row a
   class (its links counted) and a spanning forest, never pairs; small groups are bundled into tasks of block size. So
   no group is in one task, pairs are never emitted, and no partner is capped or lost.
4. components() of the verified forest gives the final groups.

Defined results of near_classes(): one row per row of docs. class_id is the least doc_id of the group that links of
similarity `threshold` or more connect; n_links counts the other rows that are linked to this one directly, copies
included; n_text_links counts other classes (different sets) linked directly. Null and wordless texts have no n-grams
and no links, and are their own class (class_id: their doc_id); repeated rows are rows like others and are linked;
null doc_ids do not count as least while there is another; texts of any length are read whole; no rows give no rows;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.components import components
from twinfold.llm.words import ALNUM, hash_words, lists, slices, split_words
from twinfold.session import stored

N = 5
THRESHOLD = 0.8
RECALL = 0.995
MOST_HASHES = 256
SLICE_BYTES = 8 << 20
BLOCK = 1024
BLOCK_GRAMS = 1 << 21

_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes that finds a pair at the threshold with the target recall."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("no banding of so few hashes has this recall")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, as flat values and bounds."""
    codes, bounds, words = split_words(column, ALNUM)
    hashed = hash_words(words)[codes]
    sizes = np.diff(bounds)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bounds[:-1] - to[:-1], count) + np.arange(to[-1])
    length = np.repeat(np.minimum(sizes, n), count)
    value = length.astype(np.uint64)
    places = _PLACES if n <= len(_PLACES) else _mix(np.arange(1, n + 1, dtype=np.uint64))
    for j in range(n):
        at = np.minimum(first + j, max(0, len(hashed) - 1))
        value = value + np.where(j < length, _mix(hashed[at] if len(hashed) else value) * places[j], np.uint64(0))
    value = _mix(value)
    row = np.repeat(np.arange(len(sizes)), count)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[fresh], np.searchsorted(row[fresh], np.arange(len(sizes) + 1))


def band_hashes(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A (texts, bands) table of band hashes; texts without n-grams must not be among them."""
    rng = np.random.default_rng(20)
    flips = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    factors = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    small = (grams >> np.uint64(32)).astype(np.uint32)
    n = len(bounds) - 1
    out = np.zeros((n, bands), np.uint64)
    step = 1 << 15  # n-grams at once, so that the arrays stay in the cache
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + step, "right")) - 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = small[bounds[a] : bounds[b]]
        starts = bounds[a:b] - bounds[a]
        for band in range(bands):
            key = np.full(b - a, band + 1, np.uint64)
            for k in range(band * rows, band * rows + rows):
                mixed = (part ^ flips[k]) * factors[k]
                key = _mix(key + np.minimum.reduceat(mixed, starts))
            out[a:b, band] = key
    return out


SIGNED = "doc_id long, doc_key long, text_key long, set_key long, grams int, bands array<long>"


def _signed(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for block in slices(batches, "text", SLICE_BYTES):
        grams, bounds = gram_sets(block.column(3), n)
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        raw = memoryview(grams.astype("<u8")).cast("B")
        edges = bounds.tolist()
        keys = np.array([xxhash.xxh3_64_intdigest(raw[8 * edges[i] : 8 * edges[i + 1]]) for i in full.tolist()], np.uint64)
        set_key = np.zeros(len(sizes), np.int64)
        set_key[full] = keys.view(np.int64)
        table = band_hashes(grams, np.append(bounds[full], bounds[-1:]) if len(full) else np.zeros(1, np.int64), bands, rows)
        ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))])
        yield pa.RecordBatch.from_arrays(
            [
                block.column(0),
                block.column(1),
                block.column(2),
                pa.array(set_key, mask=sizes == 0),
                pa.array(sizes.astype(np.int32)),
                lists(table.reshape(-1).view(np.int64), ends, pa.int64()),
            ],
            names=["doc_id", "doc_key", "text_key", "set_key", "grams", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for block in slices(batches, "text", SLICE_BYTES):
        grams, bounds = gram_sets(block.column(0), n)
        columns = [block.column(i) for i in range(1, block.num_columns)]
        yield pa.RecordBatch.from_arrays([*columns, lists(grams.view(np.int64), bounds, pa.int64())], names=[*block.schema.names[1:], "set"])


def common(codes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many codes each two of n rows share, from the (row, code) pairs of their sets."""
    order = np.argsort(codes, kind="stable")
    codes, row = codes[order], row[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    df = np.diff(np.append(heads, len(codes)))
    counts = np.zeros((n, n), np.int64)
    many = np.flatnonzero(df > max(1, n // 16))
    for at in range(0, len(many), 4096):
        own = many[at : at + 4096]
        held = np.zeros((n, len(own)), np.float32)
        to = np.concatenate([[0], np.cumsum(df[own])])
        held[row[np.repeat(heads[own] - to[:-1], df[own]) + np.arange(to[-1])], np.repeat(np.arange(len(own)), df[own])] = 1
        counts += (held @ held.T).astype(np.int64)
    for size in np.unique(df[(df > 1) & (df <= n // 16)]).tolist():
        own = heads[(df == size)]
        step = max(1, (1 << 22) // (size * size))
        for at in range(0, len(own), step):
            rows = row[own[at : at + step, None] + np.arange(size)]
            pairs = (rows[:, :, None] * n + rows[:, None, :]).reshape(-1)
            counts += np.bincount(pairs, minlength=n * n).reshape(n, n)
    return counts


def forest(linked: np.ndarray) -> np.ndarray:
    """The least row that each row is connected to, of a symmetric table of links."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(1) if len(linked) else label
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(sets: list[np.ndarray], block: np.ndarray, cross: bool, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows linked, classes linked, least connected row) of each class; cross: only pairs of different blocks count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    counts = common(np.concatenate(sets), np.repeat(np.arange(n), sizes), n)
    linked = counts >= np.ceil(threshold / (1 + threshold) * (sizes[:, None] + sizes[None, :]) - 1e-9)
    np.fill_diagonal(linked, False)
    if cross:
        linked &= block[:, None] != block[None, :]
    return linked @ copies, linked.sum(1), forest(linked)


LINKED = "set_key long, hub long, n_rows long, n_texts long"


def _verified(table: pa.Table, threshold: float) -> pa.Table:
    group, own, key, copies = (table.column(c).to_numpy() for c in ("group", "own", "set_key", "copies"))
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    held = table.column("set").combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    bounds, values = held.offsets.to_numpy(), held.values.to_numpy()
    out = []
    order = np.lexsort((key, group))
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(rows) < 2:
            continue
        n_rows, n_texts, hub = verify([values[bounds[i] : bounds[i + 1]] for i in rows], own[rows], left != right, copies[rows], threshold)
        found = n_texts > 0
        out.append((key[rows][found], key[rows][hub[found]], n_rows[found], n_texts[found]))
    columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4)]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("set_key", "hub", "n_rows", "n_texts"), columns, strict=True)})


def _candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, component) of classes that share a band hash, directly or through others."""
    banded = stored(classes.select("set_key", F.explode("bands").alias("band")), "bands")
    hubs = banded.groupBy("band").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("top")).filter("hub < top")
    hubs = stored(hubs.select("band", "hub"), "hubs")
    edges = banded.join(hubs, "band").filter("set_key <> hub").select(F.col("set_key").alias("u"), F.col("hub").alias("v"))
    return components(edges)


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links of every row of (doc_id, text)."""
    bands, rows = choose_bands(threshold, recall, most_hashes)
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("doc_key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))
    signed = stored(keyed.mapInArrow(lambda it: _signed(it, n, bands, rows), SIGNED), "signed")
    classes = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_key", "text_key")).alias("row"), F.first("grams").alias("grams"), F.first("bands").alias("bands")
    )
    classes = stored(classes, "classes")
    groups = stored(_candidate_groups(classes).select(F.col("node").alias("set_key"), F.col("component").alias("group")), "groups")

    # Blocks of large groups, bundles of small ones.
    held = classes.drop("bands").join(groups, "set_key")
    shape = held.groupBy("group").agg(F.count("*").alias("size"), F.sum("grams").alias("mass"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("mass") / block_grams)).cast("int")
    shape = stored(shape.withColumn("blocks", F.when(F.col("size") > 1, blocks).otherwise(F.lit(1))), "shape")
    small = shape.filter("blocks = 1").agg(F.sum("size").alias("size"), F.sum("mass").alias("mass")).first()
    bundles = max(1, math.ceil((small["size"] or 0) / block), math.ceil((small["mass"] or 0) / block_grams))
    placed = held.join(shape.select("group", "blocks"), "group").select(
        "group", "blocks", "set_key", "copies", "row.doc_key", "row.text_key", F.pmod(F.xxhash64("set_key"), "blocks").cast("int").alias("own")
    )
    row = ["doc_key", "text_key"]  # of one row of a class, so copies do not meet
    texts = keyed.join(placed.select(*row).hint("merge"), row, "left_semi").groupBy(*row).agg(F.min("text").alias("text"))
    texts = texts.join(placed, row).select("text", "group", "blocks", "set_key", "copies", "own")
    sets = texts.mapInArrow(lambda it: _sets(it, n), "group long, blocks int, set_key long, copies long, own int, set array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = sets.select("*", other).select(
        "group", "set_key", "copies", "own", "set",
        F.when(F.col("blocks") > 1, F.xxhash64("group")).otherwise(F.pmod(F.xxhash64("group"), F.lit(bundles))).alias("bundle"),
        F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
    )
    links = pairs.groupBy("bundle", "left", "right").applyInArrow(lambda t: _verified(t, threshold), LINKED)
    links = stored(links, "links")
    degree = links.groupBy("set_key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_texts").alias("n_texts"))
    final = components(links.select(F.col("set_key").alias("u"), F.col("hub").alias("v")))
    least = signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    labelled = least.join(final.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    class_id = labelled.groupBy("component").agg(F.min("least").alias("class_id"))
    member = labelled.join(class_id, "component").join(degree, "set_key", "left").select(
        "set_key",
        "class_id",
        (F.coalesce("n_rows", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_text_links"),
    )
    member = stored(member, "members")
    with_words = signed.filter("set_key IS NOT NULL").select("doc_id", "set_key").join(member, "set_key").select("doc_id", "class_id", "n_links", "n_text_links")
    zero = F.lit(0).cast("long")
    wordless = signed.filter("set_key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"))
    return with_words.unionByName(wordless)
