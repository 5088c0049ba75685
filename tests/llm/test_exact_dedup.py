import hashlib
import random

import pytest
from helpers import ODD, SCHEMA, clashing

from twinfold.llm import exact_dedup as E


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    order = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    out = []
    for text, own in groups.items():
        best = min(own, key=order)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(r[0], best[0], len(own), i == own.index(best), sha) for i, r in enumerate(own)]
    return sorted(map(repr, out))


def rows():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 4))) for _ in range(120)]
    return [(i + 100, t) for i, t in enumerate(texts)] + ODD


@pytest.mark.parametrize("kwargs", [{}, {"capacity": 3}, {"capacity": 1, "max_depth": 3}])
def test_against_brute_force(spark, kwargs):
    df = clashing(spark.createDataFrame(rows(), SCHEMA))
    assert sorted(repr(tuple(r)[:5]) for r in E.exact_dedup(df, **kwargs).collect()) == brute(rows())


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "x y"), (5, "x y"), (7, "xy"), (None, "z"), (None, "z"), (None, " z")]
    got = sorted(tuple(r)[:4] for r in E.exact_dedup(spark.createDataFrame(rows, SCHEMA)).fillna(-1).collect())
    assert got == [(-1, -1, 3, False), (-1, -1, 3, False), (-1, -1, 3, True), (5, 5, 3, False), (5, 5, 3, True), (7, 5, 3, False)]


def test_buckets_lie_in_one_file_in_key_order(spark, tmp_path):
    """An owner task writes whole buckets, as one range of keys."""
    import pyarrow.parquet as pq

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], SCHEMA)
    try:
        E.build_index(df, capacity=8, path=str(tmp_path / "index"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [t.to_pydict() for t in map(pq.read_table, sorted((tmp_path / "index").glob("*.parquet"))) if t.num_rows]
    buckets = [set(t["bucket"]) for t in files]
    assert len(files) > 1 and sum(map(len, buckets)) == len(set.union(*buckets))
    assert all(t["key"] == sorted(t["key"]) for t in files)


def test_directory_covers_every_key_once(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    keyed, index = E.build_index(df, capacity=3)
    assert index.count() == index.select("key").distinct().count() == keyed.select("key").distinct().count()
    sizes = index.groupBy("depth", "prefix").count().collect()
    assert max(r["count"] for r in sizes) <= 3 and len(sizes) > 1
    assert all((r["key"] % (1 << 64)) >> (64 - r["depth"]) == r["prefix"] for r in index.collect() if r["depth"])


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = E._keyed
    monkeypatch.setattr(E, "_keyed", lambda docs: real(docs).withColumn("key", F.lit(7).cast("long")))
    assert sorted(repr(tuple(r)[:5]) for r in E.exact_dedup(spark.createDataFrame(rows(), SCHEMA)).collect()) == brute(rows())


def test_no_rows(spark):
    assert E.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_sql(spark, duck):
    from twinfold.llm import queries

    sf = "/root/testdata/sf0.001"
    df = queries.op5_exact_dedup(spark, sf)
    columns, found = duck(sf, queries.OP5_SQL)
    assert sorted(df.columns) == columns and sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == found
