"""Running duplicate groups of a stream of inventory rows.

A keeper is final only when the input ends, so what a stream gives is provisional: each update holds a group's files
so far and the keeper among them. Groups are Spark's own streaming aggregates, with partial aggregation before the
state, so a hot group costs one state row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.operators.duplicates import CONTENT, keeper_order


def running_groups(stream: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """sha256, size, files and keeper so far; for output modes update and complete."""
    keys = order or keeper_order()
    best = F.min(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col("path").alias("path")))
    return stream.filter("sha256 IS NOT NULL").groupBy(*CONTENT).agg(F.count("*").alias("files"), best["path"].alias("keeper"))


def first_seen(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """The first row of each content, for output mode append; contents are forgotten `delay` after the stream's time passes them."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(CONTENT)
