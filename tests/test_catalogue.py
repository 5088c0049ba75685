"""Every query against its SQL."""

import pytest

from twinfold.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns, rows = duck(SF, ORACLES[name])
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == rows


def test_entry_works_without_the_subpackage(tmp_path):
    """The registry and all else import when the llm folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "twinfold", tmp_path / "twinfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_dup_pairs' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
