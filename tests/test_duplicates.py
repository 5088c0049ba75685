from pyspark.sql import functions as F

from twinfold.operators import decisions, duplicates

SCHEMA = "path string, size long, mtime_ns long, dev long, inode long, num_links long, is_ref boolean, sha256 string, compressed boolean, read_only boolean"


def inventory(spark, *rows):
    base = {"size": 100, "mtime_ns": 1, "dev": None, "inode": None, "num_links": None, "is_ref": False, "sha256": "s", "compressed": False, "read_only": False}
    return spark.createDataFrame([{**base, **r} for r in rows], SCHEMA)


def p(path, **more):
    return {"path": path, **more}


def pairs(df, *args, **kwargs):
    return sorted((r["keeper"], r["victim"], r["is_alias"]) for r in duplicates.duplicate_pairs(df, *args, **kwargs).collect())


def test_keeper_rules(spark):
    assert pairs(inventory(spark, p("/a"), p("/b"), p("/c"))) == [("/a", "/b", False), ("/a", "/c", False)]
    assert pairs(inventory(spark, p("/a", sha256="1"), p("/b", sha256="2"))) == []
    assert pairs(inventory(spark, p("/work/copy"), p("/ref/orig", is_ref=True))) == [("/ref/orig", "/work/copy", False)]
    assert pairs(inventory(spark, p("/a", num_links=1), p("/b", num_links=4))) == [("/b", "/a", False)]
    assert pairs(inventory(spark, p("/small"), p("/big", size=200))) == []
    compressed = inventory(spark, p("/a"), p("/z", compressed=True))
    assert pairs(compressed, duplicates.keeper_order(True)) == [("/z", "/a", False)]
    referenced = inventory(spark, p("/work/c", compressed=True), p("/ref/o", is_ref=True))
    assert pairs(referenced, duplicates.keeper_order(True)) == [("/ref/o", "/work/c", False)]


def test_unverified_files_are_in_no_group(spark):
    assert pairs(inventory(spark, p("/a", sha256=None), p("/b", sha256=None))) == []


def test_aliases(spark):
    one = {"dev": 1, "inode": 1, "num_links": 2}
    df = inventory(spark, p("/a1", **one), p("/a2", **one), p("/b", dev=1, inode=2, num_links=1))
    assert pairs(df) == [("/a1", "/a2", True), ("/a1", "/b", False)]
    assert pairs(df, list_aliases=False) == [("/a1", "/b", False)]
    two = {"dev": 1, "inode": 2, "num_links": 2}
    df = inventory(spark, p("/a1", **one), p("/a2", **one), p("/b1", **two), p("/b2", **two))
    assert pairs(df, list_aliases=False) == [("/a1", "/b1", False), ("/a1", "/b2", False)]
    same = {"dev": 1, "inode": 42}
    df = inventory(spark, p("/data/a", **same), p("/data/z-alias", **same), p("/ref/a", is_ref=True, **same), p("/data/other", dev=1, inode=43))
    assert pairs(df, list_aliases=False) == [("/ref/a", "/data/other", False)]
    assert duplicates.collapse_aliases(df).count() == 2
    assert duplicates.cow_groups(df).count() == 1


def chosen(spark, df, *choices):
    table = spark.createDataFrame([("s", 100, c) for c in choices], "sha256 string, size long, keep_path string")
    return sorted((r["keeper"], r["victim"]) for r in duplicates.chosen_pairs(df, table).collect())


def test_choices(spark):
    df = inventory(spark, p("/a"), p("/b"), p("/c"))
    assert chosen(spark, df, "/c") == [("/c", "/a"), ("/c", "/b")]
    assert chosen(spark, df, None) == [] == chosen(spark, df, "/elsewhere")
    assert chosen(spark, df) == [("/a", "/b"), ("/a", "/c")]


def test_paths_are_distinct_and_references_win(spark):
    rows = duplicates.distinct_paths(inventory(spark, p("/a"), p("/a", is_ref=True), p("/b"))).collect()
    assert sorted((r["path"], r["is_ref"]) for r in rows) == [("/a", True), ("/b", False)]


def test_hardlink_groups(spark):
    link = {"dev": 1, "inode": 7, "num_links": 2}
    df = inventory(spark, p("/b", **link), p("/a", **link), p("/x", dev=1, inode=8, num_links=2), p("/y", num_links=3))
    assert [(r["files"], r["first_path"]) for r in duplicates.hardlink_groups(df).collect()] == [(2, "/a")]


def results(spark, df, action, fresh=True, **kwargs):
    state = df.select("path", F.lit(fresh).alias("fresh"), "read_only")
    return [r["result"] for r in decisions.decide(duplicates.duplicate_pairs(df), state, action, **kwargs).orderBy("victim").collect()]


def test_decisions(spark):
    plain = inventory(spark, p("/a", dev=1, inode=1), p("/b", dev=1, inode=2))
    assert results(spark, plain, "report") == ["verified_duplicate"]
    assert [results(spark, plain, a) for a in ("delete", "hardlink", "cow")] == [["deleted"], ["hardlinked"], ["cow_cloned"]]
    assert [results(spark, plain, a, fresh=False) for a in ("report", "delete")] == [["verified_duplicate"], ["skipped_changed"]]
    linked = inventory(spark, p("/a", dev=1, inode=1), p("/b", dev=1, inode=1))
    assert results(spark, linked, "delete") == ["already_hardlinked"] == results(spark, linked, "report", skip_hardlinked=True)
    both = inventory(spark, p("/a", is_ref=True), p("/b", is_ref=True))
    assert results(spark, both, "delete") == ["skipped_ref"]
    far = inventory(spark, p("/a", dev=1, inode=1), p("/b", dev=2, inode=1))
    assert results(spark, far, "hardlink") == ["skipped_cross_device"] and results(spark, far, "delete") == ["deleted"]
    unknown = inventory(spark, p("/a", dev=1, inode=1), p("/b"))
    assert results(spark, unknown, "hardlink") == ["hardlinked"]
    locked = inventory(spark, p("/a"), p("/b", read_only=True))
    assert results(spark, locked, "delete") == ["skipped_ro"] and results(spark, locked, "delete", include_readonly=True) == ["deleted"]
    shared = spark.createDataFrame([("/a", "/b")], "keeper string, victim string")
    assert results(spark, locked, "cow", already_shared=shared) == ["already_shared"]


def test_freshness(spark):
    df = inventory(spark, p("/same", dev=1, inode=1), p("/gone"), p("/dir"), p("/late"), p("/swapped", dev=1, inode=2), p("/untimed", mtime_ns=None), p("/gone-untimed", mtime_ns=None))
    live = spark.createDataFrame(
        [("/same", True, True, 100, 1, 1, 1, False), ("/dir", True, False, 100, 1, 1, 1, False), ("/late", True, True, 100, 2, 1, 1, False), ("/swapped", True, True, 100, 1, 1, 3, False), ("/untimed", True, True, 7, 9, 1, 1, False), ("/gone", False, False, None, None, None, None, False)],
        "path string, exists boolean, is_regular boolean, size long, mtime_ns long, dev long, inode long, read_only boolean",
    )
    got = {r["path"]: r["fresh"] for r in decisions.with_freshness(df, live).collect()}
    assert got == {"/same": True, "/gone": False, "/dir": False, "/late": False, "/swapped": False, "/untimed": True, "/gone-untimed": True}


def test_summary_counts_physical_files_once(spark):
    two = {"dev": 1, "inode": 5, "num_links": 2}
    df = inventory(spark, p("/copy-a", **two), p("/copy-b", **two), p("/original", dev=1, inode=6, num_links=1))
    state = df.select("path", F.lit(True).alias("fresh"), "read_only")
    outcomes = decisions.decide(duplicates.duplicate_pairs(df), state, "report")
    row = decisions.summary(df, outcomes).first()
    assert (row["total_files"], row["duplicate_files"], row["duplicate_bytes"]) == (3, 1, 100)
