"""Compression classifier: how much better a text compresses with a dictionary of good texts than with one of bad texts.

fit() takes at most `sample` labelled texts of each class (of at most `most_chars` characters, smallest hash first)
to the driver: a documented bound. Half of them, by hash, train a zstandard dictionary per class; the others calibrate.
A text's feature is its normalised compressed-size difference, (bad - good) / (bytes + SHRINK), summed over blocks of
`block` bytes of the whole text, so that the dictionaries count for all of a long text. A logistic fit makes it a
score; the shrinkage SHRINK / (bytes + SHRINK) is its second term, as a short text's difference says little. Sampled rows
are weighted so that the classes have their shares of all usable labels, so scores mean the same at every size.
score() is a scan that compresses each text where it is read: no shuffle, and a broadcast of two dictionaries.

Defined results: a null text is empty and scored like one; every row of docs gives one row, repeated rows and null
doc_ids too; labels whose quality is null or whose document is missing are not used, and each of several rows of a
document's labels counts; where a class has no text, all scores are (good + 1) / (labelled + 2); no rows give no
rows; columns other than doc_id and text (labels: doc_id and quality) are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.words import slices, text_buffer

SAMPLE, MOST_CHARS = 3000, 1 << 16
BLOCK = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SHRINK = 64
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]  # of 1, difference, shrinkage and their product; without dictionaries only the first counts
    level: int = LEVEL
    block: int = BLOCK


def _blocks(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def train_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES, block: int = BLOCK) -> bytes:
    """A zstandard dictionary of the texts; the texts themselves where they are too few to train one."""
    import zstandard

    samples = [b for t in texts for b in _blocks(t, block)]
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Compressor:
    def __init__(self, model: Model) -> None:
        import zstandard

        self.model = model
        self.of = [
            zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            for d in (model.good, model.bad)
        ]

    def features(self, raw: bytes) -> tuple[float, float]:
        """The normalised compressed-size difference and the shrinkage."""
        good, bad = self.of
        difference = sum(len(bad.compress(b)) - len(good.compress(b)) for b in _blocks(raw, self.model.block))
        return difference / (len(raw) + SHRINK), SHRINK / (len(raw) + SHRINK)


def _terms(features: list[tuple[float, float]]) -> np.ndarray:
    x = np.array(features, float).reshape(-1, 2)
    return np.column_stack([np.ones(len(x)), x[:, 0] * 10, x[:, 1], x[:, 0] * 10 * x[:, 1]])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method over weighted rows with a small penalty; a fixed number of steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
    return w


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights of sampled rows, 1 on average, with which the classes have the shares that they have among all usable labels."""
    weight = np.array([counts[int(q)] / np.count_nonzero(y == q) for q in y])
    return weight / weight.mean()


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, most_chars: int = MOST_CHARS) -> Model:
    """Fit to labels (doc_id, quality) of docs (doc_id, text) where `usable`, a condition on doc_id, holds."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1) AND doc_id IS NOT NULL")
    if usable is not None:
        ids = ids.filter(usable)
    ids = ids.withColumn("h", F.xxhash64("doc_id"))
    counts = {r["quality"]: r["n"] for r in ids.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = [r for q in (0, 1) for r in ids.filter(F.col("quality") == q).orderBy("h", "doc_id").limit(sample).collect()]  # 2 * sample rows at most
    rows: list = []
    if picked:
        chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"], r["h"]) for r in picked], "doc_id long, quality int, h long")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        rows = texts.join(F.broadcast(chosen), "doc_id").filter(F.length("text") <= most_chars).orderBy("h", "doc_id", "text").limit(2 * sample).collect()
    raw = [(r["quality"], r["text"].encode(), r["h"] & 1) for r in rows]
    good, bad = ([t for q, t, half in raw if q == k and not half] or [t for q, t, _ in raw if q == k] for k in (1, 0))
    if not any(good) or not any(bad):
        p = (sum(q for q, _, _ in raw) + 1) / (len(raw) + 2)
        return Model(b"", b"", [float(np.log(p / (1 - p)))])
    model = Model(train_dictionary(good), train_dictionary(bad), [])
    compressor = Compressor(model)
    held = [x for x in raw if x[2]]
    held = held if {q for q, _, _ in held} == {0, 1} else raw
    y = np.array([q for q, _, _ in held])
    w = _logistic(_terms([compressor.features(t) for _, t, _ in held]), y.astype(float), class_weights(y, counts))
    return Model(model.good, model.bad, w.tolist())


def _score(batches: Iterator[pa.RecordBatch], held: object, name: str) -> Iterator[pa.RecordBatch]:
    model = held.value
    compressor = Compressor(model) if model.good else None
    for batch in slices(batches, "text", 8 << 20):
        raw, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
        edges = offsets.tolist()
        if compressor is None:
            odds = np.full(batch.num_rows, model.weights[0])
        else:
            odds = _terms([compressor.features(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]) @ np.array(model.weights)
        scores = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column `name` at its end, the score of its column text: 0 to 1, higher where quality 1 is likelier. An older column of that name goes."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(name)
    return rest.mapInArrow(lambda it: _score(it, held, name), rest.withColumn(name, F.lit(0.0)).schema)
