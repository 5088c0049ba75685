import re

import pytest
from pyspark.sql import functions as F

from twinfold.functions import digests, formatting
from twinfold.functions.glob import compile_glob, path_depth, split_base
from twinfold.plans.interactive import choose

SIGNATURES = [
    (b"", None, "0000000000000000"),
    (b"a", None, "6100c200000000c3"),
    (b"abc", None, "a16323c400000559"),
    (b"abc", 1000, "a16323c40000093e"),
    (b"hello", None, "7fa6432800001943"),
    (b"aaaa", None, "a3a2262700000b62"),
    (b"bbbb", None, "a6a72f2e00000b80"),
    (bytes([1, 2, 3, 4]), None, "0001020300000038"),
    (bytes(i % 256 for i in range(1000)), None, "777ee907fffa03fd"),
    (bytes(i % 256 for i in range(32768)), None, "faa24980e7ff7fff"),
    (bytes(i % 256 for i in range(42768)), None, "faa24980e7ffa70f"),
]


def test_weak_signature_vectors(spark):
    df = spark.createDataFrame([(i, bytearray(c), s) for i, (c, s, _) in enumerate(SIGNATURES)], "i int, c binary, s long")
    w = df.select("i", digests.weak_signature(F.col("c"), F.col("s")).alias("w")).select("i", digests.signature_hex("w.crc32", "w.sum32").alias("h"))
    assert {r["i"]: r["h"] for r in w.collect()} == {i: h for i, (_, _, h) in enumerate(SIGNATURES)}


def test_weak_signature_of_null_is_null(spark):
    df = spark.createDataFrame([(None,)], "c binary")
    assert df.select(digests.weak_signature(F.col("c")).alias("w")).first()["w"] is None


def test_weak_signature_sends_heads_and_holds_one_table(spark):
    import tracemalloc

    plan = spark.createDataFrame([(b"abc",)], "c binary").select(digests.weak_signature(F.col("c")).alias("w"))._jdf.queryExecution().toString()
    assert re.search(r"ArrowEvalPython \[signature\(substring\(\S+ 1, 32768\)", plan)
    contents = [bytes([i % 256]) * 4000 for i in range(2000)]
    tracemalloc.start()
    crc, _ = digests.weak_pairs(contents, [4000] * 2000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(crc.tolist())) == 256 and peak < 12 << 20  # the table has 8 MB


def test_format_size(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1 kB", 1280: "1.2 kB", 1792: "1.8 kB", 786432: "768 kB", 1048576: "1 MB", 1992294: "1.9 MB", 5 << 30: "5120 MB"}
    df = spark.createDataFrame([(n,) for n in cases], "n long")
    assert {r["n"]: r["s"] for r in df.select("n", formatting.format_size(F.col("n")).alias("s")).collect()} == cases
    assert {n: formatting.size_text(n) for n in cases} == cases


def test_escape_path(spark):
    cases = {"plain": "plain", 'quo"te': 'quo"te', 'evil\nDuplicate: "x"\\': 'evil\\nDuplicate: \\"x\\"\\\\', "bell\x07": "bell\\a", "\x01": "\\x01", "\x7f": "\\x7f"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r["p"]: r["s"] for r in df.select("p", formatting.escape_path(F.col("p")).alias("s")).collect()} == cases


def test_summary_text():
    lines = formatting.summary_text({"total_files": 3, "total_bytes": 64, "duplicate_files": 1, "duplicate_bytes": 32, "deleted_files": 1, "failed_files": 0})
    assert lines == ["Files:     64 B in     3 files", "Dupes:     32 B in     1 files", "  1 files deleted"]


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("*.txt", ["a.txt", ".txt"], ["a.jpg", "s/a.txt"]),
        ("**/*.txt", ["a.txt", "s/b.txt", "s/d/c.txt"], ["a.jpg"]),
        ("sub/**", ["sub", "sub/a", "sub/b/c"], ["subs/a"]),
        ("[ab].txt", ["a.txt", "b.txt"], ["c.txt", "!.txt"]),
        ("[^a]", ["b"], ["a"]),
        ("[!a]", ["!", "a"], ["b"]),
        (r"\*x", ["*x"], ["ax"]),
        ("a**b", ["ab", "axxb"], ["a/b"]),
        ("a?c", ["abc"], ["a/c", "ac"]),
        ("[a-c]x[0-9]", ["bx3"], ["dx3"]),
    ],
)
def test_glob(pattern, yes, no):
    regex = compile_glob(pattern)
    assert all(re.search(regex, "/" + p) for p in yes)
    assert not any(re.search(regex, "/" + p) for p in no)


@pytest.mark.parametrize("pattern", ["[", "[]a]", "a\\", "[a", "[a-", "[-a]"])
def test_malformed_globs(pattern):
    assert compile_glob(pattern) is None


def test_many_double_stars_end(spark):
    pattern = "/".join(["**/nope"] * 8) + "/*.bin"
    path = "/" + "/".join(["d"] * 40) + "/x.txt"
    assert spark.createDataFrame([(path,)], "p string").filter(F.col("p").rlike(compile_glob(pattern))).count() == 0


def test_split_base():
    assert split_base("/*") == ("/", "*")
    assert split_base("/*.conf") == ("/", "*.conf")
    assert split_base("/*/*.conf") == ("/", "*/*.conf")


@pytest.mark.parametrize(
    ("base", "path", "depth"),
    [("/", "/", 0), ("/", "/x.conf", 1), ("/", "/sub/x.conf", 2), ("/data", "/data", 0), ("/data", "/data/x.conf", 1), ("/data", "/data/sub/x.conf", 2), ("/data/x", "/data/xyz", 0), ("/", "relative.conf", 0)],
)
def test_path_depth(base, path, depth):
    assert path_depth(base, path) == depth


GROUP = ["/a", "/b", "/c"]


@pytest.mark.parametrize(
    ("answers", "kept"),
    [(["2"], ["/b", None]), (["a"], ["/a", "/a"]), (["s", "2"], [None, "/b"]), (["q"], [None, None]), (["x", "0", "99", "3"], [None, "/c"]), ([], [None, None]), (["x", "1", "2"], ["/a", "/b"])],
)
def test_interactive_scripts(answers, kept):
    assert [k for _, k in choose([(1, GROUP), (2, GROUP)], answers)] == kept
