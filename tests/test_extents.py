import random

import pytest
from pyspark.sql import functions as F

from twinfold.operators import extents

SCHEMA = "grp string, member int, dev long, logical long, physical long, length long, shared boolean, encoded boolean, opaque boolean"


def table(spark, *members, grp="g", dev=1):
    rows = [(grp, m, dev, i, e[0], e[1], False, "E" in e[2:], "O" in e[2:]) for m, own in enumerate(members) for i, e in enumerate(own)]
    return spark.createDataFrame(rows, SCHEMA)


CASES = [
    ([[(1000, 100), (2000, 100)], [(1050, 100)]], {0: 50, 1: 50}),
    ([[(1000, 100)], [(9000, 100)]], {0: 0, 1: 0}),
    ([[(1000, 100), (2000, 100)]] * 2, {0: 200, 1: 200}),
    ([[(1000, 100), (1300, 100)], [(1050, 200), (1350, 10)]], {0: 60, 1: 60}),
    ([[(0, 100, "E")], [(0, 100, "E")]], {0: 0, 1: 0}),
    ([[(100, 100, "E")], [(100, 40, "E")], [(100, 70, "E")]], {0: 70, 1: 40, 2: 70}),
    ([[(4096, 100), (8192, 100)], [(4096, 100), (16384, 100)]], {0: 100, 1: 100}),
    ([[(4096, 100)], [(4096, 40)]], {0: 40, 1: 40}),
    ([[(1000, 1044480)], [(259048, 786432)]], {0: 786432, 1: 786432}),
    ([[(4096, 100)], [(4096, 100)], [(999999, 100)]], {0: 100, 1: 100, 2: 0}),
    ([[(5000, 100), (4096, 100, "E")], [(5000, 100), (4096, 100)]], {0: 200, 1: 100}),
    ([[(52139610, 2097152, "O")], [(52139611, 2097152, "O")]], {0: 0, 1: 0}),
    ([[(52139610, 2097152, "O")], [(52139610, 2097152, "O")]], {0: 2097152, 1: 2097152}),
    ([[(10, 5), (15, 5)], [(12, 6)]], {0: 6, 1: 6}),
]


@pytest.mark.parametrize(("members", "shared"), CASES)
def test_shared_bytes(spark, members, shared):
    assert {r["member"]: r["shared_bytes"] for r in extents.shared_bytes(table(spark, *members)).collect()} == shared


def test_devices_are_apart(spark):
    df = table(spark, [(1000, 100)]).unionByName(table(spark, [], [(1000, 100)], dev=2))
    assert {r["shared_bytes"] for r in extents.shared_bytes(df).collect()} == {0}


def test_shared_bytes_against_units(spark):
    rng = random.Random(4)
    members = [[(rng.randint(1, 200), rng.randint(1, 30)) for _ in range(rng.randint(1, 8))] for _ in range(6)]
    held = [{u for a, n in own for u in range(a, a + n)} for own in members]
    want = {i: len(h & set().union(*(o for j, o in enumerate(held) if j != i))) for i, h in enumerate(held)}
    assert {r["member"]: r["shared_bytes"] for r in extents.shared_bytes(table(spark, *members)).collect()} == want


def equal(spark, left, right):
    df = table(spark, left, right)
    pairs = spark.createDataFrame([("g", 0, 1)], "grp string, left int, right int")
    return extents.layouts_equal(df, pairs).first()["equal"]


def test_layouts(spark):
    assert equal(spark, [(1, 5), (9, 5)], [(1, 5), (9, 5)])
    assert not equal(spark, [(1, 5), (9, 5)], [(1, 5)])
    assert not equal(spark, [(1, 5)], [(2, 5)])
    assert not equal(spark, [(0, 5)], [(0, 5)])
    assert not equal(spark, [(1, 5)], [])
    assert equal(spark, [(1, 5, "E")], [(1, 5, "E")])
    assert not equal(spark, [(1, 5, "E")], [(1, 5, "O")])
    assert not equal(spark, [(1, 5)], [(1, 5, "E")])


def test_clamp_and_flags(spark):
    df = table(spark, [(1, 10), (20, 10), (40, 10)]).withColumn("size", F.lit(2).cast("long")).withColumn("logical", F.col("logical") * 1)
    assert sorted((r["logical"], r["length"]) for r in extents.clamp(df).collect()) == [(0, 2), (1, 1)]
    assert not extents.available(table(spark, [(0, 5)])).first()["available"]
