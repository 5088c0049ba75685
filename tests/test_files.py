"""Real files: scanning, digests, actions, whole runs."""

import os

import pytest

from twinfold.plans import actions, api
from twinfold.sources import fileextents
from twinfold.sources import inventory as source


def make(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def listed(spark, root, *patterns, **flags):
    rows = source.scan(spark, [str(root / p) if p else str(root) for p in patterns], **flags)
    return sorted(os.path.relpath(r["path"], root) for r in source.files(rows).collect())


def test_patterns(spark, tmp_path):
    make(tmp_path, {"a.txt": "1", "b.jpg": "2", "sub/c.txt": "3", "sub/deep/d.txt": "4", ".hid": "5", "empty.txt": "", "[x] y/e.txt": "6"})
    assert listed(spark, tmp_path, "*.txt") == ["a.txt"]
    assert listed(spark, tmp_path, "**/*.txt") == ["[x] y/e.txt", "a.txt", "sub/c.txt", "sub/deep/d.txt"]
    assert listed(spark, tmp_path, "sub/*.txt") == ["sub/c.txt"]
    assert listed(spark, tmp_path, "*/*/*.txt") == ["sub/deep/d.txt"]
    assert listed(spark, tmp_path, "[x] y") == ["[x] y/e.txt"] == listed(spark, tmp_path, "[x] y/*.txt")
    assert ".hid" in listed(spark, tmp_path, "")
    assert "empty.txt" in listed(spark, tmp_path, "*", include_zero_length=True)
    rows = source.scan(spark, [str(tmp_path / "*.txt"), str(tmp_path / "none*")])
    assert source.zero_length(rows).count() == 1
    asked = [str(tmp_path / "*.txt"), str(tmp_path / "none*")]
    assert [r["pattern"] for r in source.pattern_misses(spark, asked, rows).collect()] == asked[1:]


def test_links_and_odd_files(spark, tmp_path):
    make(tmp_path, {"v/real.txt": "1"})
    os.symlink(tmp_path / "v", tmp_path / "latest")
    os.symlink(tmp_path / "v" / "real.txt", tmp_path / "link.txt")
    os.symlink(tmp_path, tmp_path / "v" / "loop")
    os.mkfifo(tmp_path / "v" / "pipe")
    assert listed(spark, tmp_path, "**") == ["v/real.txt"]
    assert set(listed(spark, tmp_path, "**", follow_symlinks=True)) == {"v/real.txt"}
    assert listed(spark, tmp_path, "link.txt") == ["v/real.txt"]
    assert set(listed(spark, tmp_path, "*/*.txt", follow_symlinks=True)) == {"v/real.txt"}


def find(spark, root, **options):
    return api.find(spark, api.Options([str(root)], **options))


def test_find(spark, tmp_path):
    big = bytes(i % 256 for i in range(100_000))
    head = bytes(40_000)
    make(tmp_path, {"a.txt": "same content here", "b.txt": "same content here", "c.txt": "other content her", "x.bin": big, "y.bin": big, "h1": head + b"1", "h2": head + b"2"})
    run = find(spark, tmp_path)
    assert sorted((os.path.basename(r["keeper"]), os.path.basename(r["victim"])) for r in run.outcomes.collect()) == [("a.txt", "b.txt"), ("x.bin", "y.bin")]
    assert run.summary["total_files"] == 7 and run.summary["duplicate_files"] == 2 and not run.problems
    assert run.lines().count() == 2 and run.text()[0].startswith("Files:")


def test_find_names_of_one_file(spark, tmp_path):
    make(tmp_path, {"a": "content"})
    os.link(tmp_path / "a", tmp_path / "b")
    run = find(spark, tmp_path)
    assert [r["is_alias"] for r in run.outcomes.collect()] == [True] and run.summary["duplicate_files"] == 0
    assert find(spark, tmp_path, skip_hardlinked=True).outcomes.count() == 0
    listed = api.listlink(spark, api.Options([str(tmp_path), str(tmp_path / "none*")]))
    assert listed.summary["hardlink_groups"] == 1 and listed.summary["total_files"] == 2 and listed.problems and "  1 hardlink" in "\n".join(listed.text())
    assert [os.path.basename(r["path"]) for r in listed.outcomes.collect()] == ["a", "b"]


def test_dedupe_delete_keeps_references(spark, tmp_path):
    make(tmp_path, {"ref/orig": "x" * 50, "work/copy": "x" * 50, "work/alone": "y"})
    run = api.dedupe(spark, api.Options([str(tmp_path / "work")], reference=[str(tmp_path / "ref")]), "delete")
    assert [r["result"] for r in run.outcomes.collect()] == ["deleted"]
    assert (tmp_path / "ref/orig").exists() and not (tmp_path / "work/copy").exists() and (tmp_path / "work/alone").exists()
    assert run.summary["deleted_files"] == 1


def test_dedupe_hardlink(spark, tmp_path):
    make(tmp_path, {"a": "z" * 70_000, "b": "z" * 70_000, "c": "z" * 70_000})
    run = api.dedupe(spark, api.Options([str(tmp_path)]), "hardlink")
    assert run.summary["hardlinked_files"] == 2
    assert len({os.stat(tmp_path / n).st_ino for n in "abc"}) == 1
    assert sorted(os.listdir(tmp_path)) == ["a", "b", "c"]


def test_missing_pattern_is_a_problem(spark, tmp_path):
    make(tmp_path, {"a": "1"})
    run = api.find(spark, api.Options([str(tmp_path), str(tmp_path / "none*")]))
    assert run.problems == [f'no files matched: "{tmp_path}/none*"']


def test_find_cow(spark, tmp_path):
    make(tmp_path, {"a": "q" * 9000, "b": "q" * 9000})
    run = api.find_cow(spark, api.Options([str(tmp_path), str(tmp_path / "none*")]))
    rows = run.outcomes.collect()
    assert (run.summary["cow_groups"], run.summary["duplicate_files"], run.summary["duplicate_bytes"], run.summary["total_files"]) == (1, 1, 9000, 2) and len(run.problems) == 1
    assert [os.path.basename(r["path"]) for r in rows] == ["a", "b"]
    assert all(r["shared_bytes"] in (None, 0) for r in rows)
    fileextents.query(str(tmp_path / "a"))  # None where the filesystem has no such map


def test_sharing_of_sparse_unknown_and_unasked_groups(spark):
    rows = spark.createDataFrame([(g, f"{g}{m}", 100) for g in "abcd" for m in (1, 2)], "sha256 string, path string, size long")
    place = lambda p, physical: (p, 1, 100, 0, physical, 40, False, False, False)
    none = lambda p: (p, 1, 100, *(None,) * 6)
    probed = spark.createDataFrame([place("a1", 7), place("a2", 7), none("b1"), none("b2"), place("c1", 0), place("c2", 0)], fileextents.SCHEMA)
    got = {r["path"]: r["shared_bytes"] for r in api.member_sharing(rows, probed).collect()}
    assert got == {"a1": 40, "a2": 40, "b1": 0, "b2": 0, "c1": None, "c2": None, "d1": None, "d2": None}


def test_cow_leaves_shared_storage_alone(spark, tmp_path, monkeypatch):
    make(tmp_path, {"a": "q" * 9000, "b": "q" * 9000, "c": "q" * 9000})
    where = {"a": 5 << 20, "b": 5 << 20, "c": 9 << 20}
    monkeypatch.setattr(fileextents, "query", lambda path: [(0, where[os.path.basename(path)], 12_288, True, False, False)])
    assert fileextents.same_storage(str(tmp_path / "a"), str(tmp_path / "b")) and not fileextents.same_storage(str(tmp_path / "a"), str(tmp_path / "c"))
    assert actions.act("cow", known(tmp_path / "a"), known(tmp_path / "b")) == ("already_shared", None)
    pairs = spark.createDataFrame([("h", str(tmp_path / "a"), str(tmp_path / n), False) for n in "bc"], "sha256 string, keeper string, victim string, is_alias boolean")
    layout = spark.createDataFrame([(str(tmp_path / n), 1, 9000, 0, where[n], 9000, True, False, False) for n in "abc"], fileextents.SCHEMA)
    monkeypatch.setattr(fileextents, "extents", lambda paths: layout)
    assert [os.path.basename(r["victim"]) for r in api._already_shared(pairs).collect()] == ["b"]


def known(path):
    info = os.stat(path)
    return actions.Known(str(path), info.st_size, info.st_mtime_ns, info.st_dev, info.st_ino)


def test_actions_look_again(tmp_path):
    make(tmp_path, {"a": "1", "b": "1"})
    a, b = known(tmp_path / "a"), known(tmp_path / "b")
    os.utime(tmp_path / "b", ns=(1, 1))
    assert actions.act("delete", a, b) == ("skipped_changed", None)
    os.unlink(tmp_path / "b")
    os.symlink(tmp_path / "a", tmp_path / "b")
    assert actions.act("delete", a, actions.Known(str(tmp_path / "b")))[0] == "already_hardlinked"
    os.unlink(tmp_path / "b")
    os.link(tmp_path / "a", tmp_path / "b")
    assert actions.act("hardlink", known(tmp_path / "a"), known(tmp_path / "b"))[0] == "already_hardlinked"


def test_failed_link_leaves_the_victim(tmp_path, monkeypatch):
    make(tmp_path, {"a": "1", "b": "1"})

    def refuse(*_):
        raise OSError(5, "refused")

    monkeypatch.setattr(os, "link", refuse)
    result, error = actions.act("hardlink", known(tmp_path / "a"), known(tmp_path / "b"))
    assert result == "error" and "refused" in error and sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_clone_or_say_why(tmp_path):
    make(tmp_path, {"a": "1" * 5000, "b": "1" * 5000})
    os.chmod(tmp_path / "b", 0o640)
    result, error = actions.act("cow", known(tmp_path / "a"), known(tmp_path / "b"))
    assert result == "cow_cloned" or result == "error" and "not supported" in error
    assert os.stat(tmp_path / "b").st_mode & 0o777 == 0o640 and sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_dedupe_needs_an_action(spark, tmp_path):
    with pytest.raises(ValueError):
        api.dedupe(spark, api.Options([str(tmp_path)]), "report")


def test_running_groups(spark, tmp_path):
    from twinfold.streaming.duplicates import running_groups

    schema = "path string, size long, sha256 string, is_ref boolean, num_links long"
    for i, rows in enumerate([[("/b", 1, "s", False, 1), ("/c", 1, "t", False, 1)], [("/a", 1, "s", False, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_groups(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r["sha256"], r["files"], r["keeper"]) for r in spark.table("running").collect()} == {("s", 2, "/a"), ("t", 1, "/c")}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io
    import sys

    from twinfold import __main__ as cli

    make(tmp_path, {"a": "same", "b": "same", "c": "same"})
    monkeypatch.setattr(cli, "local_session", lambda cores: spark)
    assert cli.main(["find", str(tmp_path)]) == 0
    assert "Duplicate: '" in capsys.readouterr().out
    assert cli.main(["find", str(tmp_path / "none*")]) == 1
    assert cli.main(["dedupe", "-d", "-C", str(tmp_path)]) == 1
    with pytest.raises(SystemExit):
        cli.main(["dedupe", str(tmp_path)])
    monkeypatch.setattr(sys, "stdin", io.StringIO("2\n"))
    assert cli.main(["dedupe", "-d", "-i", str(tmp_path)]) == 0
    assert os.listdir(tmp_path) == ["b"]
