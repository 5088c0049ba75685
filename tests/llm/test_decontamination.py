import random

import pytest
from helpers import ODD, SCHEMA, clashing, words

from twinfold.llm import decontamination as D

ITEMS = "item_id long, text string"


def brute(docs, items, size):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            k = min(size, len(w))
            for window in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else ():
                for i in range(len(own) - k + 1):
                    if tuple(own[i : i + k]) == window:
                        hit.update(range(i, i + k))
                        if item_id is not None:
                            found.add(str(item_id))
        out.append((doc_id, len(own), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(spark, docs, items, **kwargs):
    from pyspark.sql import functions as F

    df = clashing(spark.createDataFrame(docs, SCHEMA))
    found = D.decontaminate(df, clashing(spark.createDataFrame(items, ITEMS)), **kwargs)
    rows = found.select("doc_id", "n_words", D.hits().alias("n_hit"), F.array_sort("items").alias("items")).collect()
    return sorted(((r[0], r[1], r[2], tuple(r[3])) for r in rows), key=str)


@pytest.mark.parametrize("kwargs", [{}, {"shard_bytes": 300}, {"block_windows": 7}])
def test_against_brute_force(spark, kwargs):
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "d", "Ää", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 9]))) for i in range(12)] + [(3, text(4)), (None, text(3)), (20, None)]
    docs = [(i, text(rng.choice([0, 1, 3, 20, 60]))) for i in range(40)] + ODD
    docs += [(99, "start " + items[5][1] + " end"), (98, ", ".join(str(t) for _, t in items))]
    assert run(spark, docs, items, window=4, **kwargs) == brute(docs, items, 4)


def test_no_phrase_spans_two_documents(spark):
    assert [r[2] for r in run(spark, [(1, "a b"), (2, "c d")], [(1, "b c")])] == [0, 0]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, ())]


def test_proximity(spark):
    docs = [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 40 + "beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta")]
    rows = D.decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, "alpha beta gamma")], ITEMS), slop=6).collect()
    assert {r["doc_id"]: (r["items"], r["near_items"]) for r in rows} == {1: ([], ["7"]), 2: ([], []), 3: ([], ["7"]), 4: ([], [])}


def test_query_against_sql(spark, duck):
    from twinfold.llm import queries

    sf = "/root/testdata/sf0.001"
    df = queries.op1_decontamination(spark, sf)
    columns, rows = duck(sf, queries.OP1_SQL)
    assert sorted(df.columns) == columns and sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == rows
