"""Shared storage between the members of a group, from their physical extents.

extents: grp, member, dev, logical, physical, length, shared, encoded, opaque. Plain ranges are merged per member,
their ends are swept once per (group, device), and each member looks its ranges up at the ends, which are all
boundaries of the sweep: equi-joins only, no range join and no pair of members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.session import stored

_PLACE = ["grp", "dev"]


def _known(extents: DataFrame) -> DataFrame:
    """Unknown devices are one of their own."""
    return extents.withColumn("dev", F.coalesce("dev", F.lit(0)))


def plain(extents: DataFrame) -> DataFrame:
    """Extents with a known place whose bytes lie there as they are."""
    return extents.filter(~F.coalesce("encoded", F.lit(False)) & ~F.coalesce("opaque", F.lit(False)) & (F.col("length") > 0) & (F.coalesce("physical", F.lit(0)) != 0))


def clamp(extents: DataFrame, size: str = "size") -> DataFrame:
    """Cut extents off at the file's size; drop what lies beyond it."""
    return extents.filter(F.col("logical") < F.col(size)).withColumn("length", F.least("length", F.col(size) - F.col("logical"))).filter("length > 0")


def merged(extents: DataFrame) -> DataFrame:
    """grp, dev, member, start, end: overlapping and adjacent plain ranges of a member joined."""
    own = Window.partitionBy(*_PLACE, "member").orderBy("start", "end")
    ranges = plain(_known(extents)).select(*_PLACE, "member", F.col("physical").alias("start"), (F.col("physical") + F.col("length")).alias("end"))
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ranges.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*_PLACE, "member", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def running_sum(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """rows with `name`, the sum of value over the rows of the same keys up to each one in order (orders are distinct).

    Rows are dealt out by range, summed within each range, and each range starts from the totals of those before it:
    a group of any size spreads over many tasks."""
    dealt = stored(rows.withColumn("_value", value).repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range", *keys).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    bases = totals.select("_range", *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("_within", F.sum("_value").over(within)).join(bases, ["_range", *keys])
    return summed.withColumn(name, F.col("_base") + F.col("_within")).select(*rows.columns, name)


def _swept(ranges: DataFrame) -> DataFrame:
    """grp, dev, coord, held: units below coord that two members or more hold.

    The units are the sum of next - coord over the points from which two or more hold on. Summed by parts, each point
    adds its coord times the change of that condition, so two running sums do and no point needs its neighbour."""
    ends = ranges.select(*_PLACE, F.explode(F.array(F.struct(F.col("start").alias("coord"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("coord"), F.lit(-1).alias("delta")))).alias("e"))
    points = ends.groupBy(*_PLACE, F.col("e.coord").alias("coord")).agg(F.sum("e.delta").alias("delta"))
    depth = running_sum(points, _PLACE, "coord", F.col("delta"), "depth")
    before, now = (F.col("depth") - F.col("delta") >= 2).cast("long"), (F.col("depth") >= 2).cast("long")
    change = running_sum(depth, _PLACE, "coord", (before - now) * F.col("coord"), "change")
    return change.select(*_PLACE, "coord", (F.col("change") + now * F.col("coord")).alias("held"))


def shared_bytes(extents: DataFrame) -> DataFrame:
    """grp, member, shared_bytes: how much of each member some other member of the group holds too, encoded extents included."""
    ranges = stored(merged(extents), "merged")
    swept = stored(_swept(ranges), "swept")
    at = lambda name: swept.select(*_PLACE, F.col("coord").alias(name), F.col("held").alias(f"{name}_held"))
    sums = ranges.join(at("start"), [*_PLACE, "start"]).join(at("end"), [*_PLACE, "end"])
    direct = sums.select("grp", "member", (F.col("end_held") - F.col("start_held")).alias("n"))
    every = extents.select("grp", "member").distinct().withColumn("n", F.lit(0).cast("long"))
    return every.unionByName(direct).unionByName(encoded_shared(extents).select("grp", "member", F.col("encoded_bytes").alias("n"))).groupBy("grp", "member").agg(F.sum("n").alias("shared_bytes"))


def encoded_shared(extents: DataFrame) -> DataFrame:
    """grp, member, encoded_bytes: for each encoded or opaque extent, what the longest extent of another member at the same place covers.

    A place needs only its longest member and the longest of the rest, so no member is paired with another."""
    own = _known(extents).filter((F.coalesce("physical", F.lit(0)) != 0) & (F.col("length") > 0))
    each = own.groupBy(*_PLACE, "physical", "member").agg(F.max("length").alias("longest"))
    best = each.groupBy(*_PLACE, "physical").agg(F.max(F.struct("longest", "member")).alias("top"))
    rest = each.join(best, [*_PLACE, "physical"]).filter(F.col("member") != F.col("top.member")).groupBy(*_PLACE, "physical").agg(F.max("longest").alias("second"))
    places = best.join(rest, [*_PLACE, "physical"])
    coded = own.filter(F.coalesce("encoded", F.lit(False)) | F.coalesce("opaque", F.lit(False)))
    other = F.when(F.col("member") == F.col("top.member"), F.col("second")).otherwise(F.col("top.longest"))
    found = coded.join(places, [*_PLACE, "physical"]).select("grp", "member", F.least("length", other).alias("n"))
    return found.groupBy("grp", "member").agg(F.sum("n").alias("encoded_bytes"))


def layouts(extents: DataFrame) -> DataFrame:
    """grp, member, dev, layout: a member's extents in order, null where it can equal no other."""
    row = F.struct("logical", "physical", "length", F.coalesce("encoded", F.lit(False)).alias("encoded"), F.coalesce("opaque", F.lit(False)).alias("opaque"))
    held = extents.groupBy("grp", "member").agg(
        F.max("dev").alias("dev"), F.array_sort(F.collect_list(row)).alias("layout"), F.min(F.coalesce("physical", F.lit(0))).alias("least"), F.count_if(F.col("dev").isNull()).alias("unknown")
    )
    return held.select("grp", "member", "dev", F.when((F.col("least") != 0) & (F.col("unknown") == 0), F.col("layout")).alias("layout"))


def layouts_equal(extents: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (grp, left, right) with `equal`: the same extents on one known device; empty or unknown layouts are never equal."""
    own = layouts(extents)
    side = lambda name: own.select("grp", F.col("member").alias(name), F.col("dev").alias(f"{name}_dev"), F.col("layout").alias(f"{name}_layout"))
    both = pairs.join(side("left"), ["grp", "left"], "left").join(side("right"), ["grp", "right"], "left")
    equal: Column = (F.col("left_layout") == F.col("right_layout")) & (F.col("left_dev") == F.col("right_dev"))
    return both.select("grp", "left", "right", F.coalesce(equal, F.lit(False)).alias("equal"))


def shared_flag_bytes(extents: DataFrame) -> DataFrame:
    """grp, member, flagged_bytes: what the filesystem itself calls shared."""
    return extents.groupBy("grp", "member").agg(F.coalesce(F.sum(F.when(F.col("shared"), F.col("length"))), F.lit(0)).cast("long").alias("flagged_bytes"))


def available(extents: DataFrame) -> DataFrame:
    """grp, available: false where there are extents but none has a known place."""
    return extents.groupBy("grp").agg(F.bool_or(F.coalesce("physical", F.lit(0)) != 0).alias("available"))


def shared_ratio(shared: Column, size: Column) -> Column:
    """Per cent of the size, 0 for an empty file; null stays null."""
    return F.when(size > 0, shared * F.lit(100.0) / size).otherwise(F.when(shared.isNotNull(), F.lit(0.0)))
