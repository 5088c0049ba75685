import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
from helpers import ODD, SCHEMA, clashing

from twinfold.llm import hmm as H
from twinfold.llm import queries


def tokens(text):
    return (text or "").encode().lower().split()


def check(got, rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for d, t in rows:
        if not held(d):
            counts.update(tokens(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = {}
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own) + math.log10((ends + 1) / (total + distinct + 1))
        want.setdefault((d, held(d), len(own) + 1, sum(counts[w] > 0 for w in own) + (ends > 0), total), []).append(base)
    assert len(got) == len(rows)
    for r in got:
        bases = want[tuple(r[:5])]
        assert any(abs(b - r[5]) <= 1e-6 * abs(b) for b in bases)
        assert math.isfinite(r[6]) and r[6] < 0


def rows():
    rng = random.Random(8)
    one, two = ["the", "of", "and", "cat", "dog"], ["le", "la", "et", "chat", "chien"]
    return [(100 + i, " ".join(rng.choice(one if i % 2 else two) for _ in range(rng.randint(1, 60)))) for i in range(150)] + ODD


def test_scores(spark):
    df = clashing(spark.createDataFrame(rows(), SCHEMA)).repartition(2)
    got = H.score(df, queries._remainder(7) == 2, states=4, classes=256, passes=3, start_docs=40).collect()
    check(got, rows())
    long = [r for r in got if r["held_out"] and r["n_tokens"] > 10 and (r["doc_id"] or 0) >= 100]
    assert sum(r["score"] for r in long) > sum(r["base_score"] for r in long)  # states tell the two vocabularies apart


def test_no_rows_and_no_training_rows(spark):
    assert H.score(spark.createDataFrame([], SCHEMA), queries._remainder(7) == 2, passes=1).collect() == []
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    check(H.score(spark.createDataFrame([(i, "a b") for i in ids], SCHEMA), queries._remainder(7) == 2, passes=1).collect(), [(i, "a b") for i in ids])


def small_model(rng, states=3, classes=4):
    part = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return H.Model(part(1, states)[0], part(states, states), np.ascontiguousarray(part(states, classes + 1).T))


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    sequences = [rng.integers(0, 5, n) for n in (1, 4, 2, 6)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    scores = H.forward_scores(np.concatenate(sequences), bounds, model)
    for sequence, score in zip(sequences, scores, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(sequence)):
            p = model.start[path[0]] * model.emit[sequence[0], path[0]]
            for a, b, c in zip(path[:-1], path[1:], sequence[1:], strict=True):
                p *= model.move[a, b] * model.emit[c, b]
            total += p
        assert abs(math.log10(total) - score) < 1e-12


def test_expected_counts_are_the_sum_over_paths():
    rng = np.random.default_rng(2)
    model = small_model(rng)
    sequences = [rng.integers(0, 5, n) for n in (3, 5, 1)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    sums = H.zeros(3, 4)
    start, size = H.runs(bounds, np.ones(3, bool), 100)
    likelihood = H.expected(np.concatenate(sequences), start, size, model, sums)
    want, total = H.zeros(3, 4), 0.0
    for sequence in sequences:
        paths = {}
        for path in itertools.product(range(3), repeat=len(sequence)):
            p = model.start[path[0]] * model.emit[sequence[0], path[0]]
            for a, b, c in zip(path[:-1], path[1:], sequence[1:], strict=True):
                p *= model.move[a, b] * model.emit[c, b]
            paths[path] = p
        z = sum(paths.values())
        total += math.log10(z)
        for path, p in paths.items():
            want.start[path[0]] += p / z
            for a, b in zip(path[:-1], path[1:], strict=True):
                want.move[a, b] += p / z
            for s, c in zip(path, sequence, strict=True):
                want.emit[c, s] += p / z
    assert abs(likelihood - total) < 1e-9
    for a, b in ((sums.start, want.start), (sums.move, want.move), (sums.emit, want.emit)):
        assert np.allclose(a, b)


def test_passes_never_lose_likelihood():
    rng = np.random.default_rng(3)
    model = small_model(rng)
    sequence, bounds = rng.integers(0, 4, 300), np.array([0, 100, 180, 300])
    start, size = H.runs(bounds, np.ones(3, bool), 1000)
    before = -math.inf
    for _ in range(6):
        sums = H.zeros(3, 4)
        now = H.expected(sequence, start, size, model, sums)
        assert now >= before - 1e-6
        before, model = now, H.maximised(sums, np.full(5, 0.2), prior=1e-9)
        model.move[:] = sums.move / sums.move.sum(1, keepdims=True)
        model.start[:] = sums.start / sums.start.sum()


def test_runs_cover_every_place():
    start, size = H.runs(np.array([0, 5, 5, 16]), np.array([True, True, True]), 4)
    assert sorted(x for a, n in zip(start.tolist(), size.tolist(), strict=True) for x in range(a, a + n)) == list(range(16)) and max(size) <= 4


def test_counts_reach_shards_of_any_partition(spark, monkeypatch):
    """Partitions 0, 2048 and 4096: no shard loses its counts or gets another's."""
    from pyspark.sql import functions as F

    encode, part = H.encode, F.shiftright("shard", 20)
    monkeypatch.setattr(H, "encode", lambda *args: encode(*args).withColumn("shard", F.col("shard") + F.shiftleft(part * 2047, 20)))
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    assert H.encode(df, queries._remainder(7) == 2, H.SHARD_BYTES, 256).agg(F.max("shard")).first()[0] >= 4096 << 20
    check(H.score(df, queries._remainder(7) == 2, states=2, classes=256, passes=1, start_docs=10).collect(), rows())


def test_memory_of_a_task_is_that_of_one_shard(spark):
    """Many shards in one task: files give them one at a time, no aggregate holds the counts of several, and no row differs."""
    import pyarrow.parquet as pq

    df = spark.createDataFrame(rows(), SCHEMA).repartition(1)
    shards = H.encode(df, queries._remainder(7) == 2, 500, 256)
    sizes = [m.row_group(g).num_rows for f in shards.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata] for g in range(m.num_row_groups)]
    assert len(sizes) > 20 and set(sizes) == {1}
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        scores = H.score(df, queries._remainder(7) == 2, states=2, classes=256, passes=1, start_docs=10, shard_bytes=500)
        assert "collect_list" not in scores._jdf.queryExecution().toString()
        check(scores.collect(), rows())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
