"""Exact encoding, ORC output, packing."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import ODD, SCHEMA, clashing

from twinfold.llm import bpe, packing, token_output

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    return {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)}


def texts():
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "9", ",", "\xa0", " ", "中", "<|endoftext|>", "word", "İ", "̱", "H"]
    return [t for _, t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]


@pytest.mark.parametrize(("path", "leading"), [(BYTES, True), (WORDS, False)])
@pytest.mark.parametrize("cache", [1_000_000, 50])
def test_unit_encoder_is_exact(tokenizers, path, leading, cache):
    coder = bpe.UnitEncoder(path, leading, cache)
    own = texts()
    for at in range(0, len(own), 100):
        ids, bounds = coder.encode(pa.array(own[at : at + 100], pa.string()))
        for i, text in enumerate(own[at : at + 100]):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizers[path].encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def rows():
    return [(100 + i, t) for i, t in enumerate(texts()[:80])] + ODD


def test_token_output(spark, tokenizers, tmp_path):
    df = clashing(spark.createDataFrame(rows(), SCHEMA)).repartition(3)
    got = [tuple(r) for r in token_output.token_output(df, BYTES, path=str(tmp_path / "orc")).collect()]
    start, want = 0, []
    for doc_id, text in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizers[BYTES].encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    found = token_output.find_documents(spark, str(tmp_path / "orc"), [7, 101])
    assert {r["doc_id"] for r in found.collect()} == {7, 101}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString().replace("\n", " ")


def test_token_output_of_no_rows(spark):
    assert token_output.token_output(spark.createDataFrame([], SCHEMA), BYTES).collect() == []


@pytest.mark.parametrize("kwargs", [{}, {"window": 64}, {"window": 64, "block_bytes": 2000, "shard_tokens": 3000}])
def test_packing(spark, tokenizers, kwargs):
    window = kwargs.get("window", 4096)
    own = [r for r in rows() if r[0] is not None and r[0] != 5]
    pieces = packing.pack(clashing(spark.createDataFrame(own, SCHEMA)), WORDS, **kwargs).toPandas()
    for doc_id, text in own:
        ids = tokenizers[WORDS].encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for x in pieces[pieces.doc_id == doc_id].sort_values("start").itertuples():
            assert (x.start, x.ids_crc32, x.doc_tokens) == (at, crc(ids[at : at + x.length]), len(ids)) and x.length > 0
            at += x.length
        assert at == len(ids)
    for _, sequence in pieces.sort_values("offset").groupby("sequence_id"):
        at = 0
        for x in sequence.itertuples():
            assert x.offset == at
            at += x.length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: no padding at all


def test_packing_of_repeated_rows_and_null_ids(spark):
    pieces = packing.pack(spark.createDataFrame([(None, "a b"), (5, "c"), (5, "c")], SCHEMA), WORDS).toPandas()
    assert pieces.length.sum() == 7
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).collect() == []


def brute_packing(own, encode, end, window, shard_tokens):
    """Packing with dictionaries, over (doc_id, text, key) rows: sorted pieces (doc_id, start, length, sequence, offset)."""
    docs = [(d, encode(t) + [end], key) for d, t, key in own]
    n, mean = len(docs), max(1.0, sum(len(x) - 1 for _, x, _ in docs) / max(1, len(docs)))
    df = collections.Counter(t for _, x, _ in docs for t in set(x[:-1]))

    def weight(token, x):
        count = x[:-1].count(token)
        return round(math.log1p((n - df[token] + 0.5) / (df[token] + 0.5)) * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * (len(x) - 1) / mean)) * 65536)

    weights = [{t: weight(t, x) for t in set(x[:-1])} for _, x, _ in docs]

    def path(i):
        out, high = [], n
        while high >= 2:
            level = [(-w, t) for t, w in weights[i].items() if max(1, high // 32) < df[t] <= high]
            out.append(min(level)[1] + 1 if level else 0)
            high //= 32
        return out

    order = sorted(range(n), key=lambda i: (path(i), docs[i][2]))
    shards, total = collections.defaultdict(list), 0
    for i in order:
        shards[total // shard_tokens].append(i)
        total += len(docs[i][1])
    pieces, before = [], 0
    for shard in sorted(shards):
        left, sequence, rest, opened = list(shards[shard]), 0, None, []
        tokens = [(i, p) for i in left for p in range(len(docs[i][1]))]
        while left or rest:
            seed, start = rest or (left[0], 0)
            rest = None
            chosen = [(seed, start)]
            room = window - (len(docs[seed][1]) - start)
            left = [i for i in left if i != seed]
            score = {i: sum(weights[i].get(t, 0) for t in set(docs[seed][1][:-1])) for i in left}
            ranked = sorted((i for i in left if score[i]), key=lambda i: (-score[i], left.index(i))) + [i for i in left if not score[i]]
            for i in ranked:
                if room > 0:
                    chosen.append((i, 0))
                    left.remove(i)
                    room -= len(docs[i][1])
            at = 0
            for i, s in chosen:
                take = min(window - at, len(docs[i][1]) - s)
                opened.append((docs[i][0], s, take, before + sequence, at))
                at += take
                rest = (i, s + take) if s + take < len(docs[i][1]) else None
            if at == window:
                pieces += opened
                opened, sequence = [], sequence + 1
        flat = [(d, s + k) for d, s, take, _, _ in opened for k in range(take)]
        while flat:
            size = 1 << (len(flat).bit_length() - 1)
            for (d), run in itertools.groupby(enumerate(flat[:size]), key=lambda x: (x[1][0], x[1][1] - x[0])):
                run = list(run)
                pieces.append((d[0], run[0][1][1], len(run), before + sequence, run[0][0]))
            flat, sequence = flat[size:], sequence + 1
        before += len(tokens)
    return sorted(pieces)


def related_texts():
    rng = random.Random(3)
    names = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(40)]
    own = [(i, " ".join(rng.choice(names[4 * (i % 10) : 4 * (i % 10) + 4]) for _ in range(rng.choice([3, 14, 14, 14, 60]))) + " the of") for i in range(120)]
    return own + [(120, None), (121, " "), (122, "of " * 900)]


@pytest.mark.parametrize("shard_tokens", [400, 1500, 1 << 20])
def test_packing_against_brute_force(spark, tokenizers, shard_tokens):
    """BM25 sums, topic paths, shards and windows by dictionaries; splits, blocks and order of rows change nothing."""
    own = related_texts()
    keys = {r["doc_id"]: r["k"] for r in spark.createDataFrame(own, SCHEMA).selectExpr("doc_id", "xxhash64(doc_id, coalesce(text, '')) AS k").collect()}
    want = brute_packing([(d, t, keys[d]) for d, t in own], lambda t: tokenizers[WORDS].encode(t or "", add_special_tokens=False).ids, 2, 128, shard_tokens)
    whole = packing.pack(spark.createDataFrame(own, SCHEMA).coalesce(1), WORDS, window=128, shard_tokens=shard_tokens)
    split = packing.pack(spark.createDataFrame(own[::-1], SCHEMA).repartition(5), WORDS, window=128, shard_tokens=shard_tokens, block_bytes=300)
    for found in (whole, split):
        assert sorted(tuple(r) for r in found.select("doc_id", "start", "length", "sequence_id", "offset").collect()) == want


def test_packing_finds_neighbours_anywhere(spark):
    """Related texts that lie in different partitions share windows."""
    found = packing.pack(spark.createDataFrame(related_texts()[:120], SCHEMA).repartition(5), WORDS, window=128, block_bytes=300)
    sequences = {}
    for r in found.collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["doc_id"]))
    related = [x[0][1] % 10 == x[1][1] % 10 for x in map(sorted, sequences.values()) if len(x) > 1]
    assert len(related) > 15 and sum(related) / len(related) > 0.7


def test_a_document_that_fills_many_shards(spark):
    pieces = packing.pack(spark.createDataFrame([(1, "of " * 1000), (2, "of the"), (3, "of")], SCHEMA), WORDS, window=64, shard_tokens=100).toPandas()
    assert pieces.length.sum() == 1001 + 3 + 2 and pieces[pieces.doc_id == 1].length.sum() == 1001
