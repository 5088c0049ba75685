"""The named queries over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold import schema as S
from twinfold.functions import digests, formatting
from twinfold.functions.glob import matches, pattern_depth, recursive
from twinfold.operators import decisions, duplicates, extents
from twinfold.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: So few that different contents of one size collide.
COLLIDING_WINDOW = 3
GLOBS = ("src1*/en/**", "src[2-4]/**/*[05].txt", "*/fr/*", "**/00000001??.txt", "src?/[^e]*/*7.txt", "none/*.txt", "src[", "**")

_INVENTORY = """
WITH b AS (
  SELECT doc_id, text, '/' || source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.txt' AS path,
         CAST(strlen(text) AS BIGINT) AS size, doc_id * 1000 AS mtime_ns,
         CAST(CASE WHEN source IN ('src0', 'src1', 'src2') THEN 1 ELSE 2 END AS BIGINT) AS dev,
         source IN ('src1', 'src4', 'src8', 'src13') AS is_ref, doc_id % 5 = 0 AS compressed, doc_id % 11 = 0 AS read_only,
         sha256(text) AS sha256, doc_id % 2 AS parity
  FROM documents
), inv AS (
  SELECT doc_id, text, path, size, mtime_ns, dev, is_ref, compressed, read_only, sha256,
         1 + min(doc_id) OVER (PARTITION BY dev, sha256, parity) AS inode, count(*) OVER (PARTITION BY dev, sha256, parity) AS num_links
  FROM b
), grouped AS (
  SELECT *, count(*) OVER (PARTITION BY sha256, size) AS files FROM inv
)"""


def _keeper_sql(order: str) -> str:
    return f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sha256, size ORDER BY {order}) AS rank FROM grouped WHERE files >= 2
), pairs AS (
  SELECT v.sha256, v.size, k.path AS keeper, v.path AS victim, k.dev = v.dev AND k.inode = v.inode AS is_alias, k.dev = v.dev AS same_device,
         v.dev AS victim_dev, v.inode AS victim_inode, v.is_ref AS victim_is_ref, v.doc_id AS victim_id, k.doc_id AS keeper_id, v.read_only AS victim_read_only
  FROM ranked v JOIN ranked k ON k.sha256 = v.sha256 AND k.size = v.size AND k.rank = 1 WHERE v.rank > 1
)"""


_ORDER = "is_ref DESC, num_links DESC, path"
_PAIRS = _INVENTORY + _keeper_sql(_ORDER)
_PAIR_COLUMNS = ["sha256", "size", "keeper", "victim", "is_alias", "same_device"]


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("exact_dup_pairs", _PAIRS + " SELECT sha256, size, keeper, victim, is_alias, same_device FROM pairs")
def exact_dup_pairs(spark, sf_dir):
    return duplicates.duplicate_pairs(tables.inventory(spark, sf_dir)).select(*_PAIR_COLUMNS)


@query("dup_groups", _INVENTORY + " SELECT sha256, size, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM inv GROUP BY sha256, size HAVING count(*) >= 2")
def dup_groups(spark, sf_dir):
    return duplicates.content_groups(tables.inventory(spark, sf_dir))


def _keepers(order: list[Column] | None):
    return lambda spark, sf_dir: duplicates.keepers(tables.inventory(spark, sf_dir), order).select("sha256", "size", "keeper", "files")


def _keepers_sql(order: str) -> str:
    return _INVENTORY + _keeper_sql(order) + " SELECT sha256, size, path AS keeper, files FROM ranked WHERE rank = 1"


query("keepers_default", _keepers_sql(_ORDER))(_keepers(None))
query("keepers_compressed", _keepers_sql("is_ref DESC, compressed DESC, num_links DESC, path"))(
    lambda spark, sf_dir: duplicates.keepers(tables.inventory(spark, sf_dir), duplicates.keeper_order(True)).select("sha256", "size", "keeper", "files")
)
query("keepers_most_links", _keepers_sql("num_links DESC, mtime_ns DESC, path"))(
    lambda spark, sf_dir: duplicates.keepers(tables.inventory(spark, sf_dir), [-F.col("num_links"), -F.col("mtime_ns"), F.col("path")]).select("sha256", "size", "keeper", "files")
)


@query("keeper_ranking", _INVENTORY + _keeper_sql(_ORDER) + " SELECT sha256, size, path, CAST(rank AS BIGINT) AS rank FROM ranked")
def keeper_ranking(spark, sf_dir):
    return duplicates.ranked(tables.inventory(spark, sf_dir)).select("sha256", "size", "path", F.col("rank").cast("long").alias("rank"))


_CHOICE_SQL = _INVENTORY + ", ordered AS (SELECT *, row_number() OVER (PARTITION BY sha256, size ORDER BY " + _ORDER + ") AS rank FROM grouped WHERE files >= 2)" + """
, collapsed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256, size, dev, inode ORDER BY rank) AS alias FROM ordered) WHERE alias = 1
), choices AS (
  SELECT sha256, size, CASE WHEN min(doc_id) % 3 = 0 THEN NULL WHEN min(doc_id) % 3 = 1 THEN max(path) ELSE 'nowhere' END AS keep_path FROM grouped WHERE files >= 2 GROUP BY sha256, size HAVING min(doc_id) % 4 <> 0
), kept AS (
  SELECT o.sha256, o.size, o.path AS keeper, o.dev, o.inode FROM ordered o LEFT JOIN choices c USING (sha256, size) WHERE o.rank = 1 AND c.sha256 IS NULL
  UNION ALL SELECT l.sha256, l.size, l.path, l.dev, l.inode FROM collapsed l JOIN choices c ON c.sha256 = l.sha256 AND c.size = l.size AND c.keep_path = l.path
)
SELECT v.sha256, v.size, keeper, v.path AS victim, k.dev = v.dev AND k.inode = v.inode AS is_alias FROM kept k JOIN ordered v ON v.sha256 = k.sha256 AND v.size = k.size AND v.path <> k.keeper"""


@query("chooser_override", _CHOICE_SQL)
def chooser_override(spark, sf_dir):
    rows = tables.inventory(spark, sf_dir)
    least = F.min("doc_id")
    pick = F.when(least % 3 == 0, F.lit(None)).when(least % 3 == 1, F.max("path")).otherwise(F.lit("nowhere"))
    groups = rows.groupBy("sha256", "size").agg(F.count("*").alias("n"), pick.alias("keep_path"), least.alias("least"))
    choices = groups.filter("n >= 2 AND least % 4 <> 0").select("sha256", "size", "keep_path")
    return duplicates.chosen_pairs(rows, choices).select("sha256", "size", "keeper", "victim", "is_alias")


@query("chooser_skip", _PAIRS + " SELECT sha256, size, keeper, victim FROM pairs WHERE sha256 >= '8'")
def chooser_skip(spark, sf_dir):
    rows = tables.inventory(spark, sf_dir)
    skipped = duplicates.content_groups(rows).filter(F.col("sha256") < "8").select("sha256", "size", F.lit(None).cast("string").alias("keep_path"))
    return duplicates.chosen_pairs(rows, skipped).select("sha256", "size", "keeper", "victim")


@query("unique_files", _INVENTORY + " SELECT path, size, sha256 FROM grouped WHERE files = 1")
def unique_files(spark, sf_dir):
    return duplicates.unique_files(tables.inventory(spark, sf_dir)).select("path", "size", "sha256")


@query("duplicate_members", _INVENTORY + " SELECT path, size, sha256 FROM grouped WHERE files >= 2")
def duplicate_members(spark, sf_dir):
    return duplicates.duplicate_members(tables.inventory(spark, sf_dir)).select("path", "size", "sha256")


_FOLD_SQL = """
, heads AS (SELECT path, size, list_transform(range(1, 1 + least(octet_length(encode(text)), %d)), lambda i: CAST(('0x' || substr(hex(encode(text)), CAST(2 * i - 1 AS BIGINT), 2)) AS UBIGINT)) AS bytes FROM inv
), signed AS (
  SELECT path, size,
    list_reduce(list_prepend(CAST(0 AS UBIGINT), bytes), lambda c, b: xor(xor(xor(c, b) >> 8, ((xor(c, b) & 255) << 24)), ((xor(c, b) & 255) << 9)) & 4294967295) AS crc,
    list_reduce(list_prepend(CAST(0 AS UBIGINT), bytes), lambda s, b: ((((s + b) & 4294967295) << 1) | (((s + b) & 4294967295) >> 31)) & 4294967295) AS total
  FROM heads
)"""


def _signed(spark: SparkSession, sf_dir: str, window: int = digests.WINDOW_BYTES) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text")
    weak = docs.select("doc_id", digests.weak_signature(F.col("text"), window_bytes=window).alias("w"))
    return tables.inventory(spark, sf_dir).join(weak, "doc_id").select("*", "w.crc32", "w.sum32").drop("w")


_WEAK = ", weak AS (SELECT path, size, CAST(crc AS BIGINT) AS crc32, CAST((total + size) & 4294967295 AS BIGINT) AS sum32 FROM signed)"
_SIGNED_SQL = _INVENTORY + _FOLD_SQL % digests.WINDOW_BYTES + _WEAK
_COLLIDING_SQL = _INVENTORY + _FOLD_SQL % COLLIDING_WINDOW + _WEAK


@query("weak_signature", _SIGNED_SQL + " SELECT path, size, crc32, sum32 FROM weak")
def weak_signature(spark, sf_dir):
    return _signed(spark, sf_dir).select("path", "size", "crc32", "sum32")


@query("weak_groups", _SIGNED_SQL + " SELECT crc32, sum32, size, count(*) AS files FROM weak GROUP BY ALL HAVING count(*) >= 2")
def weak_groups(spark, sf_dir):
    return duplicates.weak_candidates(_signed(spark, sf_dir)).groupBy("crc32", "sum32", "size").agg(F.count("*").alias("files"))


@query("weak_collisions", _COLLIDING_SQL + " SELECT crc32, sum32, w.size, count(DISTINCT sha256) AS contents FROM weak w JOIN inv USING (path) GROUP BY ALL HAVING count(DISTINCT sha256) >= 2")
def weak_collisions(spark, sf_dir):
    groups = _signed(spark, sf_dir, COLLIDING_WINDOW).groupBy("crc32", "sum32", "size").agg(F.countDistinct("sha256").alias("contents"))
    return groups.filter("contents >= 2")


@query("size_candidates", _INVENTORY + " SELECT path, size FROM (SELECT path, size, count(*) OVER (PARTITION BY size) AS n FROM inv) WHERE n >= 2")
def size_candidates(spark, sf_dir):
    return duplicates.size_candidates(tables.inventory(spark, sf_dir)).select("path", "size")


@query("listlink_groups", _INVENTORY + " SELECT dev, inode, count(*) AS files, arg_min(path, (NOT is_ref, path)) AS first_path, max(size) AS size FROM inv WHERE num_links >= 2 GROUP BY dev, inode HAVING count(*) >= 2")
def listlink_groups(spark, sf_dir):
    return duplicates.hardlink_groups(tables.inventory(spark, sf_dir))


@query("listlink_members", _INVENTORY + " SELECT dev, inode, path, first_value(path) OVER (PARTITION BY dev, inode ORDER BY is_ref DESC, path) AS first_path FROM inv WHERE num_links >= 2")
def listlink_members(spark, sf_dir):
    return duplicates.hardlink_members(tables.inventory(spark, sf_dir)).select("dev", "inode", "path", "first_path")


@query("summary_listlink", _INVENTORY + " SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes, (SELECT count(*) FROM (SELECT 1 FROM inv WHERE num_links >= 2 GROUP BY dev, inode HAVING count(*) >= 2)) AS hardlink_groups FROM inv")
def summary_listlink(spark, sf_dir):
    rows = tables.inventory(spark, sf_dir)
    return decisions.listlink_summary(rows, duplicates.hardlink_groups(rows))


@query("alias_pairs", _PAIRS + " SELECT sha256, size, keeper, victim FROM pairs WHERE is_alias")
def alias_pairs(spark, sf_dir):
    return duplicates.duplicate_pairs(tables.inventory(spark, sf_dir)).filter("is_alias").select("sha256", "size", "keeper", "victim")


@query("pairs_without_aliases", _PAIRS + " SELECT sha256, size, keeper, victim FROM pairs WHERE NOT is_alias")
def pairs_without_aliases(spark, sf_dir):
    return duplicates.duplicate_pairs(tables.inventory(spark, sf_dir), list_aliases=False).select("sha256", "size", "keeper", "victim")


_COLLAPSED = _INVENTORY + f", collapsed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256, size, dev, inode ORDER BY {_ORDER}) AS alias FROM grouped) WHERE alias = 1)"


@query("physical_collapse", _COLLAPSED + " SELECT path, sha256, dev, inode FROM collapsed")
def physical_collapse(spark, sf_dir):
    return duplicates.collapse_aliases(tables.inventory(spark, sf_dir)).select("path", "sha256", "dev", "inode")


_COW_GROUPS = _COLLAPSED + f", cow AS (SELECT sha256, size, count(*) AS files, first(path ORDER BY {_ORDER}) AS keeper FROM collapsed GROUP BY sha256, size HAVING count(*) >= 2)"


@query("cow_groups", _COW_GROUPS + " SELECT sha256, size, keeper, files FROM cow")
def cow_groups(spark, sf_dir):
    return duplicates.cow_groups(tables.inventory(spark, sf_dir)).select("sha256", "size", "keeper", "files")


@query("summary_cow", _COW_GROUPS + " SELECT CAST(coalesce(sum(files % 3 * 100) FILTER (size % 7 <> 0), 0) AS BIGINT) AS cow_shared_bytes, count(*) AS cow_groups, CAST(coalesce(sum(files - 1), 0) AS BIGINT) AS duplicate_files, CAST(coalesce(sum((files - 1) * size), 0) AS BIGINT) AS duplicate_bytes FROM cow")
def summary_cow(spark, sf_dir):
    groups = duplicates.cow_groups(tables.inventory(spark, sf_dir))
    return decisions.cow_summary(groups.withColumn("shared_bytes", F.when(F.col("size") % 7 != 0, F.col("files") % 3 * 100)))


_EXTENTS = """
WITH e AS (
  SELECT l_suppkey AS grp, l_orderkey % 8 AS member, CAST(l_suppkey % 3 AS BIGINT) AS dev, CAST(l_linenumber AS BIGINT) AS logical, l_partkey + 1 AS physical,
         CAST(l_quantity AS BIGINT) AS length, l_linenumber % 3 = 0 AS shared, l_linenumber = 5 AS encoded, l_linenumber = 6 AS opaque FROM lineitem
), plain AS (SELECT * FROM e WHERE NOT encoded AND NOT opaque AND length > 0)
, units AS (SELECT DISTINCT grp, member, unnest(range(physical, physical + length)) AS unit FROM plain)
, direct AS (SELECT grp, member, count(*) AS n FROM (SELECT grp, member, count(*) OVER (PARTITION BY grp, unit) AS holders FROM units) WHERE holders >= 2 GROUP BY grp, member)
, coded AS (
  SELECT x.grp, x.member, least(x.length, o.longest) AS n FROM e x
  JOIN LATERAL (SELECT max(y.length) AS longest FROM e y WHERE y.grp = x.grp AND y.physical = x.physical AND y.member <> x.member) o ON true
  WHERE (x.encoded OR x.opaque) AND o.longest IS NOT NULL
), coded_sums AS (SELECT grp, member, CAST(sum(n) AS BIGINT) AS encoded_bytes FROM coded GROUP BY grp, member)"""


@query(
    "extent_merge",
    _EXTENTS + """, runs AS (SELECT *, unit - row_number() OVER (PARTITION BY grp, member ORDER BY unit) AS island FROM units)
SELECT grp, member, min(unit) AS "start", max(unit) + 1 AS "end" FROM runs GROUP BY grp, member, island""",
)
def extent_merge(spark, sf_dir):
    return extents.merged(tables.extents(spark, sf_dir)).select("grp", "member", "start", "end")


@query(
    "extent_shared_bytes",
    _EXTENTS + """ SELECT m.grp, m.member, CAST(coalesce(d.n, 0) + coalesce(c.encoded_bytes, 0) AS BIGINT) AS shared_bytes
FROM (SELECT DISTINCT grp, member FROM e) m LEFT JOIN direct d USING (grp, member) LEFT JOIN coded_sums c USING (grp, member)""",
)
def extent_shared_bytes(spark, sf_dir):
    return extents.shared_bytes(tables.extents(spark, sf_dir))


@query("extent_encoded_shared", _EXTENTS + " SELECT grp, member, encoded_bytes FROM coded_sums")
def extent_encoded_shared(spark, sf_dir):
    return extents.encoded_shared(tables.extents(spark, sf_dir))


def _next_members(rows: DataFrame) -> DataFrame:
    """grp, left, right: each member and the one of the next number."""
    members = rows.select("grp", "member").distinct()
    return members.select("grp", F.col("member").alias("left"), (F.col("member") + 1).alias("right")).join(members.select("grp", F.col("member").alias("right")), ["grp", "right"], "left_semi")


@query(
    "layout_equal",
    _EXTENTS + """, lay AS (SELECT grp, member, list({'l': logical, 'p': physical, 'n': length, 'e': encoded, 'o': opaque} ORDER BY logical, physical, length, encoded, opaque) AS l FROM e GROUP BY grp, member)
SELECT a.grp, a.member AS "left", b.member AS "right", a.l = b.l AS equal FROM lay a JOIN lay b ON a.grp = b.grp AND b.member = a.member + 1""",
)
def layout_equal(spark, sf_dir):
    rows = tables.extents(spark, sf_dir)
    return extents.layouts_equal(rows, _next_members(rows))


@query("shared_flag_bytes", _EXTENTS + " SELECT grp, member, CAST(coalesce(sum(length) FILTER (shared), 0) AS BIGINT) AS flagged_bytes FROM e GROUP BY grp, member")
def shared_flag_bytes(spark, sf_dir):
    return extents.shared_flag_bytes(tables.extents(spark, sf_dir))


@query("extent_clamp", _EXTENTS + " SELECT grp, member, logical, least(length, 5 - logical) AS length FROM e WHERE logical < 5")
def extent_clamp(spark, sf_dir):
    rows = tables.extents(spark, sf_dir).withColumn("size", F.lit(5).cast("long"))
    return extents.clamp(rows).select("grp", "member", "logical", "length")


@query("extent_available", _EXTENTS + " SELECT grp, bool_or(physical % 7 <> 0) AS available FROM e GROUP BY grp")
def extent_available(spark, sf_dir):
    rows = tables.extents(spark, sf_dir).withColumn("physical", F.when(F.col("physical") % 7 != 0, F.col("physical")))
    return extents.available(rows)


@query("shared_ratio", _EXTENTS + """, t AS (SELECT grp, member, CAST(sum(length) AS BIGINT) AS size, CAST(coalesce(sum(length) FILTER (shared), 0) AS BIGINT) AS flagged FROM e GROUP BY grp, member)
SELECT grp, member, CAST(round(flagged * 100.0::DOUBLE / size, 6) AS DOUBLE) AS ratio FROM t""")
def shared_ratio(spark, sf_dir):
    rows = tables.extents(spark, sf_dir)
    sizes = rows.groupBy("grp", "member").agg(F.sum("length").alias("size")).join(extents.shared_flag_bytes(rows), ["grp", "member"])
    return sizes.select("grp", "member", F.round(extents.shared_ratio(F.col("flagged_bytes"), F.col("size")), 6).alias("ratio"))


_STATE = """, state AS (
  SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN false WHEN doc_id % 29 = 0 THEN false WHEN doc_id % 13 = 0 THEN false ELSE true END AS fresh FROM inv
)"""


@query("freshness_check", _INVENTORY + _STATE + " SELECT path, fresh FROM state JOIN inv USING (doc_id)")
def freshness_check(spark, sf_dir):
    rows = tables.inventory(spark, sf_dir)
    return decisions.with_freshness(rows, tables.live_state(rows)).select("path", "fresh")


def _outcomes(spark: SparkSession, sf_dir: str, action: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.inventory(spark, sf_dir)
    pairs = duplicates.duplicate_pairs(rows, list_aliases=True)
    state = decisions.with_freshness(rows, tables.live_state(rows))
    return rows, decisions.decide(pairs, state, action)


def _decided_sql(action: str) -> str:
    if action == S.REPORT:
        rule = "'verified_duplicate'"
    else:
        device = "WHEN NOT same_device THEN 'skipped_cross_device' " if action in (S.HARDLINK, S.COW) else ""
        done = {S.DELETE: "deleted", S.HARDLINK: "hardlinked", S.COW: "cow_cloned"}[action]
        rule = f"CASE WHEN is_alias THEN 'already_hardlinked' WHEN victim_is_ref THEN 'skipped_ref' WHEN NOT (kf.fresh AND vf.fresh) THEN 'skipped_changed' {device}WHEN victim_read_only THEN 'skipped_ro' ELSE '{done}' END"
    return _PAIRS + _STATE + f""", decided AS (
  SELECT pairs.*, '{action}' AS action, {rule} AS result FROM pairs JOIN state kf ON kf.doc_id = keeper_id JOIN state vf ON vf.doc_id = victim_id
)"""


def _decision(action: str) -> None:
    @query(f"decision_{action}", _decided_sql(action) + " SELECT keeper, victim, action, result FROM decided")
    def decision(spark, sf_dir):
        return _outcomes(spark, sf_dir, action)[1].select("keeper", "victim", "action", "result")


def _summary(name: str, action: str) -> None:
    counted = ", ".join(f"count(*) FILTER (result = '{r}') AS {c}" for r, c in (("deleted", "deleted_files"), ("hardlinked", "hardlinked_files"), ("cow_cloned", "cow_cloned_files"), ("skipped_ro", "skipped_ro_files"), ("skipped_ref", "skipped_ref_files"), ("skipped_changed", "skipped_changed_files"), ("error", "failed_files")))

    @query(name, _decided_sql(action) + f""", f AS (
  SELECT victim_dev, victim_inode, max(size) AS size FROM decided WHERE NOT is_alias AND result NOT IN ('already_hardlinked', 'already_shared', 'skipped_changed') GROUP BY ALL
) SELECT (SELECT count(*) FROM inv) AS total_files, (SELECT CAST(sum(size) AS BIGINT) FROM inv) AS total_bytes,
  (SELECT count(*) FROM f) AS duplicate_files, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM f) AS duplicate_bytes, {counted} FROM decided""")
    def summary(spark, sf_dir):
        return decisions.summary(*_outcomes(spark, sf_dir, action))


@query("decision_cow_shared", _decided_sql(S.COW).replace("WHEN victim_read_only", "WHEN victim_id % 4 = 0 THEN 'already_shared' WHEN victim_read_only") + " SELECT keeper, victim, action, result FROM decided")
def decision_cow_shared(spark, sf_dir):
    rows = tables.inventory(spark, sf_dir)
    pairs = duplicates.duplicate_pairs(rows, list_aliases=True)
    shared = pairs.join(rows.filter("doc_id % 4 = 0").select(F.col("path").alias("victim")), "victim", "left_semi").select("keeper", "victim")
    return decisions.decide(pairs, decisions.with_freshness(rows, tables.live_state(rows)), S.COW, already_shared=shared).select("keeper", "victim", "action", "result")


for _action in S.ACTIONS:
    _decision(_action)
_summary("summary_find", S.REPORT)
_summary("summary_dedupe", S.HARDLINK)


@query("dup_bytes_by_source", _PAIRS + """, f AS (SELECT victim_dev, victim_inode, max(size) AS size, min(split_part(victim, '/', 2)) AS source FROM pairs WHERE NOT is_alias GROUP BY ALL)
SELECT source, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY source""")
def dup_bytes_by_source(spark, sf_dir):
    pairs = duplicates.duplicate_pairs(tables.inventory(spark, sf_dir))
    return decisions.duplicate_bytes_by(pairs, F.split_part(F.col("victim"), F.lit("/"), F.lit(2)), "source")


_GLOB_SQL = {
    "src1*/en/**": r"^/src1[^/]*/en(/[^/]+)*$",
    "src[2-4]/**/*[05].txt": r"^/src[2-4](/[^/]+)*/[^/]*[05]\.txt$",
    "*/fr/*": r"^/[^/]*/fr/[^/]*$",
    "**/00000001??.txt": r"^(/[^/]+)*/00000001[^/][^/]\.txt$",
    "src?/[^e]*/*7.txt": r"^/src[^/]/[^e/][^/]*/[^/]*7\.txt$",
    "none/*.txt": r"^/none/[^/]*\.txt$",
    "**": r"^(/[^/]+)*$",
}


@query("glob_match", _INVENTORY + " " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, path FROM inv WHERE regexp_matches(path, '{r}')" for p, r in _GLOB_SQL.items()))
def glob_match(spark, sf_dir):
    rows = tables.inventory(spark, sf_dir).select("path")
    named = F.array(*(F.when(matches(F.substr("path", F.lit(2)), p), F.lit(p)) for p in GLOBS))
    return rows.select(F.explode(F.array_compact(named)).alias("pattern"), "path")


@query("glob_depth", _INVENTORY + """, p(pattern, depth) AS (VALUES """ + ", ".join(f"('{p}', {'NULL' if recursive(p) else pattern_depth(p)})" for p in GLOBS) + """)
SELECT pattern, count(*) AS files FROM inv, p WHERE depth IS NULL OR len(string_split(path, '/')) - 1 = depth GROUP BY pattern""")
def glob_depth(spark, sf_dir):
    rows = tables.inventory(spark, sf_dir).select((F.size(F.split("path", "/")) - 1).alias("depth"))
    reachable = F.array(*(F.when((F.lit(recursive(p))) | (F.col("depth") == pattern_depth(p)), F.lit(p)) for p in GLOBS))
    return rows.select(F.explode(F.array_compact(reachable)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("files"))


@query("pattern_misses", _INVENTORY + " SELECT pattern FROM (VALUES " + ", ".join(f"('{p}', '{_GLOB_SQL.get(p, 'a^')}')" for p in GLOBS) + ") p(pattern, rx) WHERE NOT EXISTS (SELECT 1 FROM inv WHERE regexp_matches(path, rx))")
def pattern_misses(spark, sf_dir):
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, GLOBS))).alias("pattern"))
    return asked.join(glob_match(spark, sf_dir).select("pattern").distinct(), "pattern", "left_anti")


@query("zero_length_skip", "SELECT count(*) FILTER (n > 0) AS kept, count(*) FILTER (n = 0) AS zero_length FROM (SELECT strlen(CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END) AS n FROM documents)")
def zero_length_skip(spark, sf_dir):
    text = F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("text"))
    sizes = tables.documents(spark, sf_dir).select(F.octet_length(text).alias("n"))
    return sizes.agg(F.count_if(F.col("n") > 0).alias("kept"), F.count_if(F.col("n") == 0).alias("zero_length"))


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference walk and a normal walk that overlap."""
    rows = tables.inventory(spark, sf_dir).select("path", "size", "doc_id").withColumn("is_ref", F.lit(False))
    again = rows.filter("doc_id % 3 = 0").withColumn("is_ref", F.lit(True))
    return again.unionByName(rows.filter("doc_id % 2 = 0")).select("path", "size", "is_ref")


@query("path_distinct", _INVENTORY + " SELECT path, size, doc_id % 3 = 0 AS is_ref FROM inv WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def path_distinct(spark, sf_dir):
    return duplicates.distinct_paths(_roles(spark, sf_dir))


@query("ref_union", _INVENTORY + " SELECT path, size, true AS is_ref FROM inv WHERE doc_id % 3 = 0 UNION ALL SELECT path, size, false FROM inv WHERE doc_id % 2 = 0")
def ref_union(spark, sf_dir):
    return _roles(spark, sf_dir)


@query("format_size", """WITH s AS (SELECT doc_id, size FROM (SELECT doc_id, unnest([n_chars, n_chars * 1024, n_chars * 256, n_chars * 262144, n_chars * 77777, doc_id * 1048576]) AS size FROM documents))
SELECT doc_id, size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 AND size % 1024 = 0 THEN (size // 1024) || ' kB' WHEN size < 1048576 THEN printf('%.1f kB', size / 1024.0::DOUBLE)
 WHEN size % 1048576 = 0 THEN (size // 1048576) || ' MB' ELSE printf('%.1f MB', size / 1048576.0::DOUBLE) END AS formatted FROM s""")
def format_size(spark, sf_dir):
    n, d = F.col("n_chars"), F.col("doc_id")
    sizes = tables.documents(spark, sf_dir).select("doc_id", F.explode(F.array(n, n * 1024, n * 256, n * 262144, n * 77777, d * 1048576)).alias("size"))
    return sizes.withColumn("formatted", formatting.format_size(F.col("size")))


@query("escape_path", """SELECT doc_id, CASE WHEN regexp_matches(p, '[\\x00-\\x1f\\x7f]') THEN replace(replace(replace(replace(p, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(1), '\\x01') ELSE p END AS escaped
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a' || chr(10) || 'b"\\' WHEN 1 THEN 'a"\\b' WHEN 2 THEN 'x' || chr(1) ELSE 'plain' END || doc_id AS p FROM documents)""")
def escape_path(spark, sf_dir):
    k = F.col("doc_id") % 4
    base = F.when(k == 0, F.lit('a\nb"\\')).when(k == 1, F.lit('a"\\b')).when(k == 2, F.lit("x\x01")).otherwise(F.lit("plain"))
    return tables.documents(spark, sf_dir).select("doc_id", formatting.escape_path(F.concat(base, F.col("doc_id").cast("string"))).alias("escaped"))


@query("report_lines", _decided_sql(S.HARDLINK) + """ SELECT keeper, victim, CASE result WHEN 'hardlinked' THEN 'Hardlinked: ''' || victim || '''' WHEN 'skipped_ro' THEN 'Skipping duplicate readonly file ''' || victim || '''.'
 WHEN 'skipped_changed' THEN 'Skipping ''' || victim || ''' (original ''' || keeper || '''): one of them changed during the scan.' END AS line FROM decided""")
def report_lines(spark, sf_dir):
    outcomes = _outcomes(spark, sf_dir, S.HARDLINK)[1]
    line = formatting.report_line(F.col("keeper"), F.col("victim"), F.col("result"), F.col("is_alias"))
    return outcomes.select("keeper", "victim", line.alias("line"))
