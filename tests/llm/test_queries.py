"""Registered queries against their SQL, on whole small tables."""

import pytest

from twinfold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns, rows = duck(SF, queries.ORACLES[name])
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == rows


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_quality_contract(spark):
    import zlib

    rows = queries.op8_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
