"""One query per operator over its whole table, with production parameters, and the SQL where it exists."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import decontamination, exact_dedup, hmm, language, licenses, near_join, packing, quality, secrets, token_output

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontamination.hits().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM windows
), grams AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS key
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, sizes WHERE len(w) >= k)
), found AS (SELECT doc_id, i, g.k, item_id FROM grams g JOIN windows USING (k, key)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex", "entropy")),
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


def _pattern_spans_sql(rank: int) -> str:
    kind, pattern, group, least = secrets.PATTERNS[rank]
    rx = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS start,
    length(found[i]) AS size, length(vals[i]) AS counted, {least} AS least, found[i] AS text
  FROM (SELECT doc_id, string_split_regex(t, '{rx}') AS gaps, regexp_extract_all(t, '{rx}', 0) AS found, regexp_extract_all(t, '{rx}', {group}) AS vals,
    unnest(range(1, len(regexp_extract_all(t, '{rx}', 0)) + 1)) AS i FROM d WHERE regexp_matches(t, '{rx}'))"""


def _op2_sql() -> str:
    """Base spans by splitting, entropy spans by counting every window anew."""
    most = " ".join(f"WHEN regexp_matches(c, '{p}') THEN {math.floor(secrets.WINDOW * (math.log2(secrets.WINDOW) - bits) * secrets.UNIT)}" for _, p, bits in secrets.CLASSES)
    allowed = " AND ".join(f"NOT regexp_matches(text, '{p}')" for p in secrets.ALLOWED)
    rx, w = secrets.CANDIDATE, secrets.WINDOW
    kinds = ", ".join(f"'{p[0]}'" for p in secrets.PATTERNS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), base AS (
  SELECT doc_id, rank, start, start + size AS "end" FROM ({" UNION ALL ".join(_pattern_spans_sql(r) for r in range(len(secrets.PATTERNS)))}) WHERE counted >= least
), cand AS (
  SELECT doc_id, text AS c, CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS start FROM (
    SELECT doc_id, gaps, found, i, found[i] AS text FROM (
      SELECT doc_id, string_split_regex(t, '{rx}') AS gaps, regexp_extract_all(t, '{rx}', 0) AS found, unnest(range(1, len(regexp_extract_all(t, '{rx}', 0)) + 1)) AS i FROM d WHERE regexp_matches(t, '{rx}'))
  ) WHERE {allowed}
), win AS (SELECT doc_id, start, c, k, substr(c, k + 1, {w}) AS piece FROM (SELECT doc_id, start, c, unnest(range(0, length(c) - {w - 1})) AS k FROM cand)
), chars AS (SELECT doc_id, start, c, k, ch, count(*) AS n FROM (SELECT doc_id, start, c, k, unnest(regexp_extract_all(piece, '.')) AS ch FROM win) GROUP BY ALL
), sums AS (SELECT doc_id, start, c, k, sum(([{", ".join(map(str, secrets.PLOGP))}])[n + 1]) AS total FROM chars GROUP BY ALL
), hot AS (SELECT doc_id, start + min(k) AS start, start + max(k) + {w} AS "end" FROM sums WHERE total <= CASE {most} END GROUP BY doc_id, sums.start, c
), more AS (SELECT doc_id, {len(secrets.PATTERNS)} AS rank, start, "end" FROM hot h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.start < h."end" AND h.start < b."end")
), named AS (SELECT doc_id, rank, start, ([{kinds}, '{secrets.ENTROPY}'])[rank + 1] || ':' || start || ':' || "end" AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM more)
), sums_by AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_entropy,
    string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans FROM named GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN sums_by USING (doc_id)"""


OP2_SQL = _op2_sql()


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    best = F.sort_array(F.transform("licenses", lambda x: F.struct((-x["coverage"]).alias("c"), x["name"].alias("name"))))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.get(best, F.lit(0))["name"].alias("license"),
        F.coalesce(-F.get(best, F.lit(0))["c"], F.lit(0.0)).alias("coverage"),
        F.array_join(spans, ",").alias("spans"),
    )


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_classes(_table(spark, sf_dir, "documents"))


#: All pairs that share an n-gram, whole sets compared, and groups by following links to smaller ids.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS key FROM g GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 10 * k >= 8 * (a.n + b.n - k)
), reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
), class AS (SELECT u AS doc_id, min(v) AS class_id FROM reach GROUP BY u
), counted AS (SELECT u AS doc_id, count(*) AS n_links, count(DISTINCT b.key) FILTER (b.key <> a.key) AS n_text_links FROM links JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = v GROUP BY u)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links FROM class LEFT JOIN counted USING (doc_id)
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("row_key")


OP5_SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), ranked AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS place
  FROM keyed
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""


def _remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null ids have none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_VOCABULARY, end=2, window=4096)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), F.coalesce(_remainder(4) != 2, F.lit(False)))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, end=0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_license_scan": op3_license_scan,
    "op4_near_join": op4_near_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_hmm_scoring": op6_hmm_scoring,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_token_output": op9_token_output,
    "op10_language": op10_language,
}
ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_secret_scan": OP2_SQL, "op4_near_join": OP4_SQL, "op5_exact_dedup": OP5_SQL}
