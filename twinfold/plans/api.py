"""find, listlink, find_cow and dedupe over files: from patterns to outcomes and a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold import schema as S
from twinfold.functions.formatting import report_line, summary_text
from twinfold.operators import decisions, duplicates, extents
from twinfold.plans import actions
from twinfold.session import shared_path, ship, stored
from twinfold.sources import content, fileextents
from twinfold.sources import inventory as source


@dataclass(frozen=True)
class Options:
    patterns: list[str]
    reference: list[str] = field(default_factory=list)
    follow_symlinks: bool = False
    include_zero_length: bool = False
    include_readonly: bool = False
    prefer_compressed: bool = False
    skip_hardlinked: bool = False


@dataclass
class Run:
    """What a run found: tables, the one-row summary and its printed form, and why it fails, if it does."""

    inventory: DataFrame
    outcomes: DataFrame
    errors: DataFrame
    summary: dict
    problems: list[str]

    def lines(self) -> DataFrame:
        """Result lines, in order of keeper and victim."""
        line = report_line(F.col("keeper"), F.col("victim"), F.col("result"), F.col("is_alias"))
        return self.outcomes.select("keeper", "victim", line.alias("line")).filter("line IS NOT NULL").orderBy("keeper", "victim")

    def text(self) -> list[str]:
        return summary_text(self.summary)


def _scanned(spark: SparkSession, options: Options) -> tuple[DataFrame, DataFrame, list[str]]:
    """(inventory of distinct paths, all scanned rows, problems)."""
    flags = {"follow_symlinks": options.follow_symlinks, "include_zero_length": options.include_zero_length}
    rows = source.scan(spark, options.patterns, **flags)
    if options.reference:
        rows = source.scan(spark, options.reference, is_ref=True, **flags).unionByName(rows)
    rows = stored(rows, "scan")
    missed = [r["pattern"] for r in source.pattern_misses(spark, [*options.reference, *options.patterns], rows).collect()]  # patterns the caller named
    problems = ["no files matched: " + ", ".join(f'"{p}"' for p in missed)] if missed else []
    return duplicates.distinct_paths(source.files(rows)), rows, problems


def _digested(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inventory with sha256 where a copy is possible, unreadable paths): sizes, then weak signatures, then contents."""
    weak = stored(content.with_weak_signature(duplicates.size_candidates(files)), "weak")
    full = stored(content.with_sha256(duplicates.weak_candidates(weak)), "digests")
    bad = weak.filter("read_error IS NOT NULL").select("path").unionByName(full.filter("read_error IS NOT NULL").select("path")).distinct()
    return full.drop("crc32", "sum32", "read_error"), bad


def _compressed(files: DataFrame, probe: bool) -> DataFrame:
    if not probe:
        return files.withColumn("compressed", F.lit(False))
    own = fileextents.extents(files).groupBy("path").agg(F.bool_or("encoded").alias("compressed"))
    return files.join(own, "path", "left").withColumn("compressed", F.coalesce("compressed", F.lit(False)))


def _already_shared(pairs: DataFrame) -> DataFrame:
    """keeper and victim of the pairs whose layouts are equal: their storage is shared as it is."""
    pairs = pairs.filter("NOT is_alias").select(F.col("sha256").alias("grp"), F.col("keeper").alias("left"), F.col("victim").alias("right"))
    paths = pairs.select("grp", F.col("left").alias("path")).unionByName(pairs.select("grp", F.col("right").alias("path"))).distinct()
    own = fileextents.extents(paths).join(paths, "path").withColumnRenamed("path", "member")
    return extents.layouts_equal(stored(own, "layouts"), pairs).filter("equal").select(F.col("left").alias("keeper"), F.col("right").alias("victim"))


def _finish(files: DataFrame, scanned: DataFrame, outcomes: DataFrame, bad: DataFrame | None, summary: DataFrame, problems: list[str]) -> Run:
    found, counters = source.errors(scanned), summary.first().asDict()
    counters["zero_length_files"] = source.zero_length(scanned).count()
    counters["cant_read_files"] = found.count() + (bad.count() if bad is not None else 0)
    if counters.get("failed_files"):
        problems = [*problems, f"{counters['failed_files']} files could not be processed"]
    return Run(files, outcomes, found, counters, problems)


Choices = DataFrame | Callable[[DataFrame], DataFrame] | None


def _run(spark: SparkSession, options: Options, action: str, choices: Choices) -> Run:
    ship(spark)
    files, scanned, problems = _scanned(spark, options)
    held, bad = _digested(files)
    held = stored(_compressed(held, options.prefer_compressed and action == S.COW), "members")
    order = duplicates.keeper_order(options.prefer_compressed and action == S.COW)
    aliases = action == S.REPORT and not options.skip_hardlinked
    if callable(choices):
        choices = choices(duplicates.ranked(duplicates.collapse_aliases(held, order), order))
    pairs = duplicates.duplicate_pairs(held, order, aliases) if choices is None else duplicates.chosen_pairs(held, choices, order, aliases)
    state = held.select("path", F.lit(True).alias("fresh"), "read_only")
    shared = _already_shared(pairs) if action == S.COW else None
    outcomes = stored(decisions.decide(pairs, state, action, options.skip_hardlinked, options.include_readonly, shared), "outcomes")
    if action != S.REPORT:
        outcomes = actions.apply(outcomes, held, shared_path(spark, "results"), options.include_readonly)
    return _finish(files, scanned, outcomes, bad, decisions.summary(files, outcomes), problems)


def find(spark: SparkSession, options: Options, choices: Choices = None) -> Run:
    """Report duplicates; with skip_hardlinked, names of one file are no duplicates.

    choices (sha256, size, keep_path) name other keepers; a function gets the ranked members and returns them."""
    return _run(spark, options, S.REPORT, choices)


def dedupe(spark: SparkSession, options: Options, action: str, choices: Choices = None) -> Run:
    """Delete, hard-link or clone the victims; choices as in find()."""
    if action not in (S.DELETE, S.HARDLINK, S.COW):
        raise ValueError("exactly one of delete, hardlink and cow is needed")
    if options.prefer_compressed and action != S.COW:
        raise ValueError("compressed files are preferred only by cow")
    return _run(spark, options, action, choices)


def listlink(spark: SparkSession, options: Options) -> Run:
    """A run whose outcomes are dev, inode, first_path, path of every name in a group of hard links; no file is read."""
    ship(spark)
    files, scanned, problems = _scanned(spark, options)
    members = duplicates.hardlink_members(files).select("dev", "inode", "first_path", "path").orderBy("first_path", "path")
    return _finish(files, scanned, members, None, decisions.listlink_summary(files, duplicates.hardlink_groups(files)), problems)


def member_sharing(rows: DataFrame, probed: DataFrame) -> DataFrame:
    """rows (sha256, path, ...) with shared_bytes: what each member shares with the rest of its group.

    probed: rows of fileextents.SCHEMA. Null where no file of the group could be asked, or where there are extents but none
    has a known place; a group of sparse files shares 0."""
    raw = stored(probed.join(rows.select("path", F.col("sha256").alias("grp")), "path").withColumnRenamed("path", "member"), "extents")
    own = extents.clamp(raw)
    asked = raw.select(F.col("grp").alias("sha256")).distinct().withColumn("asked", F.lit(True))
    known = extents.available(own).select(F.col("grp").alias("sha256"), "available")
    shared = extents.shared_bytes(own).select(F.col("grp").alias("sha256"), F.col("member").alias("path"), F.col("shared_bytes").alias("known"))
    out = rows.join(shared, ["sha256", "path"], "left").join(known, "sha256", "left").join(asked, "sha256", "left")
    told = F.col("asked") & F.coalesce("available", F.lit(True))
    return out.withColumn("shared_bytes", F.when(told, F.coalesce("known", F.lit(0)))).drop("known", "available", "asked")


def find_cow(spark: SparkSession, options: Options) -> Run:
    """A run whose outcomes are sha256, size, keeper, path, shared_bytes, ratio of every physical file of each group of equal content.

    shared_bytes and ratio are null where the filesystem tells no extents."""
    ship(spark)
    files, scanned, problems = _scanned(spark, options)
    held, bad = _digested(files)
    held = held.withColumn("compressed", F.lit(False))
    groups = duplicates.cow_groups(held).select("sha256", "size", "keeper", "files")
    rows = stored(duplicates.collapse_aliases(held).select("path", "sha256", "size").join(groups, ["sha256", "size"]), "cow")
    out = stored(member_sharing(rows, fileextents.probed(rows)), "sharing")
    each = out.groupBy("sha256", "size", "files").agg(F.sum("shared_bytes").alias("shared_bytes"))
    totals = decisions.listlink_summary(files, each.limit(0)).drop("hardlink_groups")
    members = out.select("sha256", "size", "keeper", "path", "shared_bytes", extents.shared_ratio(F.col("shared_bytes"), F.col("size")).alias("ratio")).orderBy("keeper", "path")
    return _finish(files, scanned, members, bad, decisions.one_row(totals, decisions.cow_summary(each)), problems)
