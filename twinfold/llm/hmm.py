"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact scaled forward scores.

The corpus is encoded once into shared files: a shard is a run of whole documents of at most `shard_bytes` of text,
one row with its own vocabulary, its words' classes and codes, and its training counts. Everything after works on
codes. A shard is a row group of its own, so that writers and readers hold one at a time, and scoring gets one shard
and its words' counts at a time, however many shards a task has.

* Word counts: shard vocabularies are summed by word, pre-aggregated before the shuffle; the table grows with the corpus
  and is never broadcast. A sort-merge join sends each shard the counts of its own words back, where other shards hold them
  too; a word that many shards hold is one key with a row a shard, which adaptive execution splits.
* The model: hidden states emit word classes, and a class emits its words by their counts:
  p(text) = sum over state paths of prod p(state | state before) p(class | state) p(word | class). A word's class is its
  hash, one of `classes`, so that the parameters have a fixed size (states * classes numbers), which is what is
  broadcast; frequent words have a class to themselves but for rare ones. p(word | class) is (c + 1) / (N_class +
  V_class + 1), which leaves one place for unseen words of the class. The end of a text is a word with a class of its own.
* Training: each pass reads every training document. A task adds up its expected counts and gives one row per
  parameter, and Spark sums these over tasks. Texts are cut into runs of at most `run` words here, so that memory is
  bounded; each run starts afresh. The passes start from a model fitted on the driver to `start_docs` training
  documents (of at most START_CHARS characters) of the smallest hashes, which only breaks the symmetry of the states; no count of it is kept.
* Scores: the forward recursion, rescaled at every word, over whole texts of any length. Texts of a shard advance
  together. The result is the exact likelihood under the model.

Defined results: words are runs of characters outside 20 and 09-0D, with A-Z in lower case, and the end; a null text is
empty and has the end alone; rows with a null doc_id are training rows; repeated rows are rows like others; without
training rows all counts are 0 and base and model scores are finite; no rows give no rows; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.words import SPACED, lists, slices, split_words
from twinfold.session import stored

STATES = 8
CLASSES = 1 << 15
PASSES = 4
#: The start is fitted to so many training documents of at most so many characters.
START_DOCS, START_CHARS = 400, 1 << 16
START_PASSES = 12
RUN = 4096
SHARD_BYTES = 12 << 20
#: Expected counts that the corpus-wide class distribution adds to every state.
PRIOR = 2000.0
#: Words whose forward and backward values are held at once.
BATCH = 1 << 18

SHARDS = "shard long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, words array<string>, classes array<int>, counts array<int>, codes binary"


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes + 1 x states; the last row is the end


def word_classes(words: list[bytes], classes: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return (np.fromiter((digest(w, 42) for w in words), np.uint64, len(words)) % np.uint64(classes)).astype(np.int32)


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int, classes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, block in enumerate(slices(batches, "text", shard_bytes)):
        codes, bounds, words = split_words(block.column(1), SPACED)
        sizes = np.diff(bounds)
        held = block.column(2).to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words))
        one = [0, len(sizes)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 20) + k]),
                pa.ListArray.from_arrays(pa.array(one, pa.int32()), pa.concat_arrays([block.column(0)])),
                lists(held, one, pa.bool_()),
                lists(sizes.astype(np.int32), one, pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.large_string()).cast(pa.string())),
                lists(word_classes(words.to_pylist(), classes), [0, len(words)], pa.int32()),
                lists(counts.astype(np.int32), [0, len(words)], pa.int32()),
                pa.array([codes.astype("<i4").tobytes()], pa.binary()),
            ],
            names=["shard", "doc_ids", "held_out", "sizes", "words", "classes", "counts", "codes"],
        )


def encode(docs: DataFrame, held_out: Column, shard_bytes: int = SHARD_BYTES, classes: int = CLASSES) -> DataFrame:
    """The shards of (doc_id, text), written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return stored(rows.mapInArrow(lambda it: _shards(it, shard_bytes, classes), SHARDS), "shards", group_rows=1)


def _opened(batch: pa.RecordBatch | pa.Table, k: int) -> tuple[np.ndarray, ...]:
    """held_out, sizes, word classes, codes of row k of a batch of shards."""
    held, sizes, classes = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("held_out", "sizes", "classes"))
    return held.astype(bool), sizes.astype(np.int64), classes, np.frombuffer(batch.column("codes")[k].as_py(), "<i4")


def with_ends(classes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences with the end after each, and the n + 1 bounds."""
    return np.insert(classes, np.cumsum(sizes), np.int32(end)), np.concatenate([[0], np.cumsum(sizes + 1)])


def runs(bounds: np.ndarray, keep: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of at most `run` places of the kept sequences."""
    first, size = bounds[:-1][keep], np.diff(bounds)[keep]
    pieces = -(-size // run)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + k * run
    return start, np.minimum(run, np.repeat(first + size, pieces) - start)


def expected(sequence: np.ndarray, start: np.ndarray, size: np.ndarray, model: Model, sums: Model) -> float:
    """Add the expected counts of runs to `sums`; the runs' log likelihood."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    total, at = 0.0, 0
    ends = np.cumsum(size)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, "right")))
        total += _expected_batch(sequence, start[at:to], size[at:to], model, sums)
        at = to
    return total


def _expected_batch(sequence: np.ndarray, start: np.ndarray, size: np.ndarray, model: Model, sums: Model) -> float:
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), "left")  # runs longer than t
    edge = np.concatenate([[0], np.cumsum(active)]).tolist()
    seen = np.concatenate([sequence[start[:n] + t] for t, n in enumerate(active.tolist())])
    states = len(model.start)
    emit = model.emit[seen]
    forward = np.empty_like(emit)
    scale = np.empty((len(seen), 1))
    ones = np.ones((states, 1))
    before = forward
    for t in range(steps):
        a, b = edge[t], edge[t + 1]
        here = forward[a:b]
        if t:
            np.matmul(before[: b - a], model.move, out=here)
            here *= emit[a:b]
        else:
            np.multiply(emit[a:b], model.start, out=here)
        np.matmul(here, ones, out=scale[a:b])
        here /= scale[a:b]
        before = here
    emit /= scale
    move = np.zeros_like(model.move)
    turned = np.ascontiguousarray(model.move.T)
    back = np.ones((len(start), states))  # of runs that end at t, still ones
    for t in range(steps - 1, -1, -1):
        a, b = edge[t], edge[t + 1]
        if t < steps - 1:
            n = edge[t + 2] - b
            after = emit[b : b + n]
            after *= back[:n]
            move += forward[a : a + n].T @ after
            np.matmul(after, turned, out=back[:n])
        forward[a:b] *= back[: b - a]
    sums.start += forward[: edge[1]].sum(0)
    sums.move += move * model.move
    for k, column in enumerate(np.ascontiguousarray(forward.T)):
        sums.emit[:, k] += np.bincount(seen, column, minlength=len(sums.emit))
    return float(np.log10(scale).sum())


def zeros(states: int, classes: int) -> Model:
    return Model(np.zeros(states), np.zeros((states, states)), np.zeros((classes + 1, states)))


def maximised(sums: Model, shares: np.ndarray, prior: float = PRIOR) -> Model:
    """The model of expected counts; `shares` (classes + 1, sum 1) is the corpus-wide distribution that smooths emissions."""
    emit = sums.emit + prior * shares[:, None]
    move = sums.move + 1.0
    start = sums.start + 1.0
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def first_model(texts: list[str | None], shares: np.ndarray, states: int, passes: int, run: int = RUN) -> Model:
    """A start for the passes: fitted to a few documents from a fixed random model whose states tend to stay."""
    rng = np.random.default_rng(6)
    classes = len(shares) - 1
    emit = shares[:, None] * rng.lognormal(0, 1, (classes + 1, states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    model = Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    codes, bounds, words = split_words(pa.array(texts, pa.string()), SPACED)
    own = word_classes(words.to_pylist(), classes)[codes] if len(words) else codes
    sequence, edges = with_ends(own, np.diff(bounds), classes)
    start, size = runs(edges, np.ones(len(texts), bool), run)
    for _ in range(passes if len(texts) else 0):
        sums = zeros(states, classes)
        expected(sequence, start, size, model, sums)
        model = maximised(sums, shares, prior=200.0)
    return model


def _pass(batches: Iterator[pa.RecordBatch], held: object, run: int) -> Iterator[pa.RecordBatch]:
    model = held.value
    classes = len(model.emit) - 1
    sums, likelihood, any_rows = zeros(len(model.start), classes), 0.0, False
    for batch in batches:
        for k in range(batch.num_rows):
            out, sizes, own, codes = _opened(batch, k)
            sequence, edges = with_ends(own[codes], sizes, classes)
            start, size = runs(edges, ~out, run)
            if len(start):
                likelihood += expected(sequence, start, size, model, sums)
                any_rows = True
    if any_rows:
        flat = np.concatenate([sums.start, sums.move.ravel(), sums.emit.ravel(), [likelihood]])
        cells = np.flatnonzero(flat)
        for at in range(0, len(cells), 1 << 16):
            part = cells[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(flat[part].astype(np.float32))], names=["cell", "value"])


def baum_welch(shards: DataFrame, model: Model, run: int = RUN) -> tuple[Model, float]:
    """Expected counts of all training documents under the model (a fixed number of cells), and their log10 likelihood."""
    held = shards.sparkSession.sparkContext.broadcast(model)
    read = shards.select("held_out", "sizes", "classes", "codes")
    cells = read.mapInArrow(lambda it: _pass(it, held, run), "cell int, value float").groupBy("cell").agg(F.sum("value").alias("value"))
    states, rows = len(model.start), len(model.emit)
    flat = np.zeros(states + states * states + rows * states + 1)
    found = cells.toArrow()
    flat[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    a, b = states, states + states * states
    return Model(flat[:a], flat[a:b].reshape(states, states), flat[b:-1].reshape(rows, states)), float(flat[-1])


def forward_scores(sequence: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of every class sequence; all advance together, one place at a time."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][order], size[order]
    scores = np.zeros(len(size))
    if not len(size):
        return scores
    state = np.zeros((len(size), len(model.start)))
    ones = np.ones(len(model.start))
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()
    for t, n in enumerate(active):
        emit = model.emit[sequence[start[:n] + t]]
        here = emit * (state[:n] @ model.move if t else model.start)
        scale = here @ ones
        np.divide(here, scale[:, None], out=state[:n])
        scores[:n] += np.log10(scale)
    out = np.empty(len(scores))
    out[order] = scores
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(shard: pa.Table, counted: pa.Table, held: object, total: int, distinct: int, ends: int) -> pa.Table:
    """The scores of one shard's rows; `counted` has the counts of its words that other shards hold too."""
    model, class_tokens, class_words = held.value
    classes = len(model.emit) - 1
    room = total + distinct + 1
    out, sizes, own, codes = _opened(shard, 0)
    count = shard.column("counts")[0].values.to_numpy(zero_copy_only=False).astype(np.int64)
    count[counted.column("place").to_numpy()] = counted.column("count").to_numpy()
    base = np.log10((count + 1) / room)
    inner = np.log10((count + 1) / (class_tokens[own] + class_words[own] + 1))
    edge = np.concatenate([[0], np.cumsum(sizes)])

    def summed(values: np.ndarray) -> np.ndarray:
        found = np.zeros(len(edge) - 1)
        full = np.flatnonzero(np.diff(edge))
        if len(full):
            found[full] = np.add.reduceat(values[codes], edge[:-1][full])
        return found

    sequence, bounds = with_ends(own[codes], sizes, classes)
    return pa.Table.from_arrays(
        [
            shard.column("doc_ids")[0].values,
            pa.array(out),
            pa.array(sizes + 1),
            pa.array(summed((count > 0).astype(float)).astype(np.int64) + (ends > 0)),
            pa.array(np.full(len(sizes), total)),
            pa.array(summed(base) + np.log10((ends + 1) / room)),
            pa.array(summed(inner) + forward_scores(sequence, bounds, model)),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score(
    docs: DataFrame,
    held_out: Column,
    states: int = STATES,
    classes: int = CLASSES,
    passes: int = PASSES,
    start_docs: int = START_DOCS,
    shard_bytes: int = SHARD_BYTES,
    run: int = RUN,
) -> DataFrame:
    """Train on the rows of (doc_id, text) where held_out is not true, and score all rows."""
    spark = docs.sparkSession
    shards = encode(docs, held_out, shard_bytes, classes)
    slots = shards.select("shard", "classes", "counts", F.posexplode("words").alias("place", "word"))
    summed = slots.select("word", F.col("classes")[F.col("place")].alias("class"), F.col("counts")[F.col("place")].alias("n")).groupBy("word")
    words = stored(summed.agg(F.sum("n").alias("count"), F.max("class").alias("class"), F.count("*").alias("shards")).filter("count > 0"), "words")
    elsewhere = words.filter("shards > 1").select("word", "count")  # of the others, a shard has the count itself
    counted = slots.select(F.col("shard").alias("of"), "place", "word").join(elsewhere.hint("merge"), "word").drop("word")
    told = shards.select(F.count("*").alias("shards"), F.sum(F.size(F.filter("held_out", lambda h: ~h))).alias("ends")).first()
    ends = told["ends"] or 0
    # A few shards a task, for as long as the session's partitions allow: adaptive execution would put many into one.
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * told["shards"]))
    table = words.groupBy("class").agg(F.sum("count").alias("tokens"), F.count("*").alias("words")).toArrow()  # a row a class
    class_tokens, class_words = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    class_tokens[table.column("class").to_numpy()] = table.column("tokens").to_numpy()
    class_words[table.column("class").to_numpy()] = table.column("words").to_numpy()
    total, distinct = int(class_tokens.sum()) + ends, int(class_words.sum()) + (ends > 0)
    shares = np.append(class_tokens + class_words + 1, ends + 1).astype(float)
    shares /= shares.sum()

    model = first_model(start_texts(docs.filter(~F.coalesce(held_out, F.lit(False))), start_docs), shares, states, START_PASSES, run)
    for _ in range(passes):
        sums, _ = baum_welch(shards, model, run)
        model = maximised(sums, shares)

    rows = shards.select("shard", "doc_ids", "held_out", "sizes", "classes", "counts", "codes").repartition(tasks, "shard")
    held = spark.sparkContext.broadcast((model, class_tokens, class_words))

    def scored(shard: pa.Table, known: pa.Table) -> pa.Table:
        return _scored(shard, known, held, total, distinct, ends)

    return rows.groupBy("shard").cogroup(counted.repartition(tasks, "of").groupBy("of")).applyInArrow(scored, SCORES)


def start_texts(docs: DataFrame, count: int) -> list[str]:
    """The texts of the `count` smallest hashes: hashes first, so that no task sends texts that others beat."""
    text = F.col("text").cast("string")
    usable = docs.filter(F.length(text) <= START_CHARS).select(F.xxhash64(F.col("doc_id"), text).alias("h"), text.alias("text"))
    least = [r["h"] for r in usable.select("h").orderBy("h").limit(count).collect()]
    return [r["text"] for r in usable.filter(F.col("h") <= least[-1]).orderBy("h").limit(count).collect()] if least else []
