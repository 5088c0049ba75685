"""A Spark data source that lists files: spark.read.format("fileinventory").

Options: `patterns` (one a line), `is_ref`, `followSymlinks`, `includeZeroLength`, `caseInsensitive`. A pattern that
names an existing path is taken literally. A partition is a subtree directly below a pattern's base, so a cluster
that mounts the files lists subtrees in parallel. Rows are files and, with `error_kind` set, what could not be read.
File contents are read later, only for candidates: see twinfold.sources.content.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from twinfold.functions.glob import compile_glob, pattern_depth, recursive, split_base

SCHEMA = (
    "pattern string, path string, size long, mtime_ns long, dev long, inode long, num_links long, is_ref boolean, read_only boolean, "
    "zero_length boolean, error_kind string, message string"
)


@dataclass
class Subtree(InputPartition):
    pattern: str
    base: str
    match: str
    start: str  # where to walk: the base itself, or a directory below it
    inside: str  # the start's place below the base, as patterns see it
    deep: bool  # False: only the files directly in start

    def __post_init__(self) -> None:
        InputPartition.__init__(self, self.start)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.patterns = [p for p in options.get("patterns", "").split("\n") if p]
        flag = lambda name: str(options.get(name, "false")).lower() == "true"
        self.is_ref, self.follow, self.zero, self.fold = flag("is_ref"), flag("followsymlinks"), flag("includezerolength"), flag("caseinsensitive")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for pattern in self.patterns:
            path = os.path.abspath(pattern)
            if os.path.exists(path):
                base, match = path, "**"
                if not os.path.isdir(path):
                    base, match = os.path.split(path)[0], ""
                    out.append(Subtree(pattern, base, match, path, "", False))
                    continue
                if os.path.islink(path) and not self.follow:
                    continue
            else:
                base, match = split_base(pattern)
                base = os.path.abspath(base)
            out.append(Subtree(pattern, base, match, base, "", False))
            if recursive(match) or pattern_depth(match) > 1:
                try:
                    names = sorted(e.name for e in os.scandir(base) if e.is_dir(follow_symlinks=self.follow))
                except OSError:
                    names = []  # the walk of the base reports it
                out += [Subtree(pattern, base, match, os.path.realpath(os.path.join(base, n)) if self.follow else os.path.join(base, n), n, True) for n in names]
        return out or [Subtree("", "", "", "", "", False)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        if not partition.pattern:
            return
        if not partition.match and not partition.deep:
            yield from self._file(partition, partition.start, os.path.realpath(partition.start) if os.path.islink(partition.start) else partition.start)
            return
        regex = compile_glob(partition.match, self.fold)
        if regex is None:
            return
        seen: set[tuple[int, int]] = set()
        limit = None if recursive(partition.match) else pattern_depth(partition.match)
        yield from self._walk(partition, partition.start, partition.inside, re.compile(regex.replace(r"\x{10FFFF}", "\U0010ffff")), limit, seen)

    def _walk(self, partition: Subtree, folder: str, inside: str, regex: re.Pattern, limit: int | None, seen: set) -> Iterator[tuple]:
        stack = [(folder, inside)]
        while stack:
            folder, inside = stack.pop()
            if self.follow:
                try:
                    info = os.stat(folder)
                except OSError:
                    continue
                if (info.st_dev, info.st_ino) in seen:
                    continue
                seen.add((info.st_dev, info.st_ino))
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as e:
                yield self._error(partition, folder, "denied" if isinstance(e, PermissionError) else "error", e)
                continue
            for entry in entries:
                place = f"{inside}/{entry.name}" if inside else entry.name
                path = entry.path
                if entry.is_symlink():
                    if not self.follow or not os.path.exists(path):
                        continue
                    path = os.path.realpath(path)
                if os.path.isdir(path):
                    if partition.deep and (limit is None or place.count("/") + 1 < limit):
                        stack.append((path, place))
                    continue
                if regex.match("/" + place):
                    yield from self._file(partition, entry.path, path)

    def _file(self, partition: Subtree, named: str, path: str) -> Iterator[tuple]:
        try:
            info = os.stat(path, follow_symlinks=False)
        except OSError as e:
            yield self._error(partition, named, "error", e)
            return
        if not stat.S_ISREG(info.st_mode):
            return
        empty = info.st_size == 0
        yield (
            partition.pattern, path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), info.st_size, info.st_mtime_ns, _signed(info.st_dev), _signed(info.st_ino),
            info.st_nlink, self.is_ref, not os.access(path, os.W_OK), empty and not self.zero, None, None,
        )

    def _error(self, partition: Subtree, path: str, kind: str, error: OSError) -> tuple:
        return (partition.pattern, path, None, None, None, None, None, self.is_ref, None, False, kind, str(error))


class FileInventory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fileinventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InventoryReader:
        return InventoryReader({k.lower(): v for k, v in dict(self.options).items()} | {"is_ref": dict(self.options).get("is_ref", "false")})


def scan(spark: SparkSession, patterns: list[str], is_ref: bool = False, follow_symlinks: bool = False, include_zero_length: bool = False, case_insensitive: bool = False) -> DataFrame:
    """All rows of the source for these patterns, kept in the session so that later steps see one state of the files."""
    spark.dataSource.register(FileInventory)
    flags = {"is_ref": is_ref, "followSymlinks": follow_symlinks, "includeZeroLength": include_zero_length, "caseInsensitive": case_insensitive}
    return spark.read.format("fileinventory").options(patterns="\n".join(patterns), **{k: str(v).lower() for k, v in flags.items()}).load()


def pattern_misses(spark: SparkSession, patterns: list[str], scanned: DataFrame) -> DataFrame:
    """Patterns that gave no row at all, neither file nor error."""
    asked = spark.createDataFrame([(p,) for p in dict.fromkeys(patterns)], "pattern string")
    return asked.join(scanned.select("pattern").distinct(), "pattern", "left_anti")


def files(scanned: DataFrame) -> DataFrame:
    """Inventory rows: files that are not skipped for their length."""
    return scanned.filter(F.col("error_kind").isNull() & ~F.col("zero_length")).select("path", "size", "mtime_ns", "dev", "inode", "num_links", "is_ref", "read_only")


def zero_length(scanned: DataFrame) -> DataFrame:
    """Paths skipped for their length, once each per role."""
    return scanned.filter("zero_length").select("path", "is_ref").distinct()


def errors(scanned: DataFrame) -> DataFrame:
    return scanned.filter("error_kind IS NOT NULL").select("path", "pattern", F.col("error_kind").alias("kind"), "message")
