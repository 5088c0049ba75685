"""Freshness, the decision table, and the summary of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold import schema as S
from twinfold.operators.duplicates import identity


def fresh(live: str = "live_", known: str = "") -> Column:
    """Whether a file is as it was scanned. Without a recorded time only a file that is no regular one has changed."""
    at = lambda name: F.col(f"{live}{name}")
    was = lambda name: F.col(f"{known}{name}")
    moved = at("dev").isNotNull() & was("dev").isNotNull() & (at("dev") != was("dev")) | at("inode").isNotNull() & was("inode").isNotNull() & (at("inode") != was("inode"))
    return (
        F.when(~F.coalesce(at("exists"), F.lit(False)), was("mtime_ns").isNull())
        .when(~F.coalesce(at("is_regular"), F.lit(False)), False)
        .when(was("mtime_ns").isNull(), True)
        .when((at("size") != was("size")) | (at("mtime_ns") != was("mtime_ns")), False)
        .otherwise(~F.coalesce(moved, F.lit(False)))
    )


def with_freshness(inventory: DataFrame, live: DataFrame) -> DataFrame:
    """path, fresh and live read_only of every inventory row; live is a live_state table."""
    now = live.select("path", *(F.col(c).alias(f"live_{c}") for c in live.columns if c != "path"))
    return inventory.join(now, "path", "left").select("path", fresh().alias("fresh"), F.coalesce("live_read_only", "read_only", F.lit(False)).alias("read_only"))


def decide(pairs: DataFrame, state: DataFrame, action: str, skip_hardlinked: bool = False, include_readonly: bool = False, already_shared: DataFrame | None = None) -> DataFrame:
    """pairs with `action` and `result`, what a run would do; the first rule that applies decides.

    state: path, fresh, read_only, as with_freshness() gives it. already_shared: (keeper, victim) pairs whose layouts are equal."""
    if action not in S.ACTIONS:
        raise ValueError(f"unknown action {action}")
    mine = state.select(F.col("path").alias("keeper"), F.col("fresh").alias("keeper_fresh"))
    other = state.select(F.col("path").alias("victim"), F.col("fresh").alias("victim_fresh"), F.col("read_only").alias("victim_read_only"))
    df = pairs.join(mine, "keeper", "left").join(other, "victim", "left")
    shared = F.lit(False)
    if action == S.COW and already_shared is not None:
        df = df.join(already_shared.select("keeper", "victim", F.lit(True).alias("_shared")), ["keeper", "victim"], "left")
        shared = F.coalesce("_shared", F.lit(False))
    does = action != S.REPORT
    result = F.when(F.col("is_alias"), F.lit("already_hardlinked" if does or skip_hardlinked else "verified_duplicate"))
    if not does:
        result = result.otherwise(F.lit("verified_duplicate"))
    else:
        stale = ~(F.coalesce("keeper_fresh", F.lit(True)) & F.coalesce("victim_fresh", F.lit(True)))
        result = result.when(F.coalesce("victim_is_ref", F.lit(False)), "skipped_ref").when(stale, "skipped_changed")
        if action in (S.HARDLINK, S.COW):
            result = result.when(~F.col("same_device"), "skipped_cross_device")
        if action == S.COW:
            result = result.when(shared, "already_shared")
        if not include_readonly:
            result = result.when(F.coalesce("victim_read_only", F.lit(False)), "skipped_ro")
        result = result.otherwise(F.lit({S.DELETE: "deleted", S.HARDLINK: "hardlinked", S.COW: "cow_cloned"}[action]))
    return df.select(*pairs.columns, F.lit(action).alias("action"), result.alias("result"))


def one_row(*tables: DataFrame) -> DataFrame:
    """The columns of tables of one row each, side by side."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def summary(inventory: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of counters. A victim's physical file counts once; aliases and withdrawn decisions hold no duplicate storage."""
    totals = inventory.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
    counted = outcomes.filter(~F.col("result").isin(*S.NOT_DUPLICATED) & ~F.col("is_alias"))
    files = counted.withColumnsRenamed({"victim_dev": "dev", "victim_inode": "inode"}).groupBy(identity("victim").alias("f")).agg(F.max("size").alias("size"))
    dupes = files.agg(F.count("*").alias("duplicate_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("duplicate_bytes"))
    of = lambda *names: F.count_if(F.col("result").isin(*names))
    results = outcomes.agg(
        of("deleted").alias("deleted_files"), of("hardlinked").alias("hardlinked_files"), of("cow_cloned").alias("cow_cloned_files"), of("skipped_ro").alias("skipped_ro_files"),
        of("skipped_ref").alias("skipped_ref_files"), of("skipped_changed").alias("skipped_changed_files"), of("error").alias("failed_files"),
    )
    return one_row(totals, dupes, results)


def listlink_summary(inventory: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: all listed names, their bytes, and groups of hard links."""
    totals = inventory.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
    return one_row(totals, groups.agg(F.count("*").alias("hardlink_groups")))


def cow_summary(groups: DataFrame) -> DataFrame:
    """One row: groups, files and bytes beyond the first of each, and the bytes that members share already (unknown: 0).

    groups: files, size, and shared_bytes of all members where that is known."""
    zero = F.lit(0)
    shared = F.coalesce(F.sum("shared_bytes"), zero).cast("long") if "shared_bytes" in groups.columns else zero.cast("long")
    return groups.agg(
        shared.alias("cow_shared_bytes"),
        F.count("*").alias("cow_groups"),
        F.coalesce(F.sum(F.col("files") - 1), zero).cast("long").alias("duplicate_files"),
        F.coalesce(F.sum((F.col("files") - 1) * F.col("size")), zero).cast("long").alias("duplicate_bytes"),
    )


def duplicate_bytes_by(pairs: DataFrame, key: Column, name: str) -> DataFrame:
    """Files and bytes held twice, by a key of the victim; each physical file once, aliases not at all."""
    files = pairs.filter("NOT is_alias").withColumnsRenamed({"victim_dev": "dev", "victim_inode": "inode"}).groupBy(identity("victim").alias("f")).agg(F.max("size").alias("size"), F.min(key).alias(name))
    return files.groupBy(name).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
