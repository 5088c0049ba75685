"""Queries over whole contents and layouts, on small tables where a part of them would not do."""

from twinfold.plans.catalogue import QUERIES


def fold(content, window):
    crc = total = 0
    for byte in content[:window]:
        crc ^= byte
        crc = (crc >> 8) ^ ((crc & 255) << 24) ^ ((crc & 255) << 9)
        total = (total + byte) & 0xFFFFFFFF
        total = (total << 1 | total >> 31) & 0xFFFFFFFF
    return crc, (total + len(content)) & 0xFFFFFFFF


def test_weak_signatures_read_the_whole_window(spark, tmp_path):
    opening = "The same opening of many texts. " * 4
    texts = [opening + "a" * 40, opening + "b" * 40, opening + "b" * 40, opening * 300 + "x", opening * 300 + "y", "short", "", opening * 200 + "x" + "z" * 400, opening * 200 + "y" + "z" * 400]
    rows = [(i, "src1", "en", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r["path"][-14:-4]): (r["crc32"], r["sum32"]) for r in QUERIES["weak_signature"](spark, str(tmp_path)).collect()}
    assert got == {i: fold(t.encode(), 32768) for i, t in enumerate(texts)}
    groups = {(r["crc32"], r["sum32"], r["size"], r["files"]) for r in QUERIES["weak_groups"](spark, str(tmp_path)).collect()}
    # Texts 3 and 4 differ beyond the window only.
    assert groups == {(*got[1], len(texts[1]), 2), (*got[3], len(texts[3]), 2)}


def test_layouts_compare_all_extents(spark, tmp_path):
    """Members 0 and 1 are equal; each later one differs from the one before in one thing beyond its first place."""
    first = [(1, 9, 4), (2, 19, 5)]
    members = [first, first, [(1, 9, 4), (2, 19, 6)], [(1, 9, 4), (2, 20, 6)], [(1, 9, 4), (5, 20, 6)], [(1, 9, 4), (6, 20, 6)], [(1, 12, 4), (6, 20, 6)], [(1, 12, 4)]]
    rows = [(3, 8 * n + m, line, part, float(quantity)) for m, own in enumerate(members) for n, (line, part, quantity) in enumerate(own)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["left"], r["right"]): r["equal"] for r in QUERIES["layout_equal"](spark, str(tmp_path)).collect()}
    assert got == {(m, m + 1): m == 0 for m in range(7)}
