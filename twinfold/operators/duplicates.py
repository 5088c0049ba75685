"""Groups of identical content, keepers, victims, aliases.

All operators take and return inventory DataFrames. Groups are pre-aggregated (count, least member) before the
shuffle, and members meet their group's keeper by an equi-join that adaptive execution can split, so a group that
holds a third of all rows never has to fit into one task. Rows without a digest are in no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTENT = ["sha256", "size"]


def keeper_order(prefer_compressed: bool = False) -> list[Column]:
    """Sort keys, least first: references, compressed files if preferred, more links (unknown counts as none), path."""
    compressed = [~F.coalesce("compressed", F.lit(False))] if prefer_compressed else []
    return [~F.coalesce("is_ref", F.lit(False)), *compressed, -F.coalesce("num_links", F.lit(0)), F.col("path")]


def _ordered(order: list[Column] | None, *carried: str) -> Column:
    keys = order or keeper_order()
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(c) for c in carried))


def identity(path: str = "path") -> Column:
    """A key of the physical file: device and inode, or the path itself where they are unknown."""
    return F.coalesce(F.concat(F.lit("i:"), F.col("dev").cast("string"), F.lit(":"), F.col("inode").cast("string")), F.concat(F.lit("p:"), F.col(path)))


def distinct_paths(inventory: DataFrame) -> DataFrame:
    """One row per path; a path that is a reference anywhere is a reference."""
    others = [c for c in inventory.columns if c not in ("path", "is_ref")]
    grouped = inventory.groupBy("path").agg(F.max("is_ref").alias("is_ref"), F.max_by(F.struct(*others), F.coalesce("is_ref", F.lit(False))).alias("r"))
    return grouped.select("path", "is_ref", *(F.col(f"r.{c}").alias(c) for c in others)).select(*inventory.columns)


def size_candidates(inventory: DataFrame) -> DataFrame:
    """Rows whose size another row has: only they can have copies, so only they need a weak signature."""
    sizes = inventory.groupBy("size").agg(F.count("*").alias("n")).filter("n >= 2").select("size")
    return inventory.join(sizes, "size", "left_semi")


def weak_candidates(signed: DataFrame) -> DataFrame:
    """Rows whose (crc32, sum32, size) another row has: only they need a content digest."""
    keys = ["crc32", "sum32", "size"]
    groups = signed.filter("crc32 IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n")).filter("n >= 2").select(*keys)
    return signed.join(groups, keys, "left_semi")


def content_groups(inventory: DataFrame) -> DataFrame:
    """sha256, size, files, bytes of content held by two rows or more."""
    return inventory.filter("sha256 IS NOT NULL").groupBy(*CONTENT).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).filter("files >= 2")


def keepers(inventory: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """sha256, size, keeper, files and the keeper's identity, for each group of two or more."""
    best = inventory.filter("sha256 IS NOT NULL").groupBy(*CONTENT).agg(F.count("*").alias("files"), F.min(_ordered(order, "path", "dev", "inode", "is_ref")).alias("b"))
    return best.filter("files >= 2").select(
        *CONTENT, F.col("b.path").alias("keeper"), F.col("b.dev").alias("keeper_dev"), F.col("b.inode").alias("keeper_inode"), F.col("b.is_ref").alias("keeper_is_ref"), "files"
    )


def collapse_aliases(inventory: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row per physical file and content: the first path in keeper order."""
    first = inventory.filter("sha256 IS NOT NULL").groupBy(*CONTENT, identity().alias("_file")).agg(F.min(_ordered(order, *[c for c in inventory.columns if c not in CONTENT])).alias("b"))
    return first.select(*(F.col(c) if c in CONTENT else F.col(f"b.{c}").alias(c) for c in inventory.columns))


def same_file(left: str, right: str) -> Column:
    """Whether two rows are one physical file; unknown identities are not."""
    return F.coalesce((F.col(f"{left}dev") == F.col(f"{right}dev")) & (F.col(f"{left}inode") == F.col(f"{right}inode")), F.lit(False))


def same_device(left: str, right: str) -> Column:
    """Whether two rows may be on one device; an unknown device may."""
    return F.col(f"{left}dev").isNull() | F.col(f"{right}dev").isNull() | (F.col(f"{left}dev") == F.col(f"{right}dev"))


def _paired(members: DataFrame, kept: DataFrame, list_aliases: bool) -> DataFrame:
    victims = members.filter("sha256 IS NOT NULL").select(
        *CONTENT, F.col("path").alias("victim"), F.col("dev").alias("victim_dev"), F.col("inode").alias("victim_inode"), F.col("is_ref").alias("victim_is_ref")
    )
    pairs = victims.join(kept.drop("files"), CONTENT).filter("victim <> keeper")
    pairs = pairs.withColumn("is_alias", same_file("keeper_", "victim_")).withColumn("same_device", same_device("keeper_", "victim_"))
    return pairs if list_aliases else pairs.filter("NOT is_alias")


def duplicate_pairs(inventory: DataFrame, order: list[Column] | None = None, list_aliases: bool = True) -> DataFrame:
    """Keeper and victim of every path that is not its group's keeper; aliases of the keeper only if asked for."""
    return _paired(inventory, keepers(inventory, order), list_aliases)


def chosen_pairs(inventory: DataFrame, choices: DataFrame, order: list[Column] | None = None, list_aliases: bool = True) -> DataFrame:
    """As duplicate_pairs(), where choices (sha256, size, keep_path) name other keepers.

    A choice must be a member after aliases collapse; a null or other choice skips its group."""
    kept = keepers(inventory, order)
    members = collapse_aliases(inventory, order).select(*CONTENT, F.col("path").alias("keep_path"), "dev", "inode", "is_ref")
    named = choices.select(*CONTENT, "keep_path").dropDuplicates(CONTENT)
    valid = named.join(members, [*CONTENT, "keep_path"]).select(
        *CONTENT, F.col("keep_path").alias("keeper"), F.col("dev").alias("keeper_dev"), F.col("inode").alias("keeper_inode"), F.col("is_ref").alias("keeper_is_ref")
    )
    free = kept.drop("files").join(named.select(*CONTENT), CONTENT, "left_anti")
    chosen = kept.select(*CONTENT).join(valid, CONTENT)
    return _paired(inventory, free.unionByName(chosen), list_aliases)


def unique_files(inventory: DataFrame) -> DataFrame:
    """Rows whose content no other row has."""
    return inventory.filter("sha256 IS NOT NULL").join(content_groups(inventory).select(*CONTENT), CONTENT, "left_anti")


def duplicate_members(inventory: DataFrame) -> DataFrame:
    return inventory.join(content_groups(inventory).select(*CONTENT), CONTENT, "left_semi")


def hardlink_groups(inventory: DataFrame) -> DataFrame:
    """dev, inode, files, first path and bytes of files that have several listed names and two links or more."""
    linked = inventory.filter("dev IS NOT NULL AND inode IS NOT NULL AND num_links >= 2")
    first = F.min(F.struct(~F.coalesce("is_ref", F.lit(False)), F.col("path").alias("path")))
    return linked.groupBy("dev", "inode").agg(F.count("*").alias("files"), first["path"].alias("first_path"), F.max("size").alias("size")).filter("files >= 2")


def hardlink_members(inventory: DataFrame) -> DataFrame:
    """Every name in a hardlink group, with its group's first path."""
    return inventory.join(hardlink_groups(inventory).select("dev", "inode", "first_path"), ["dev", "inode"])


def cow_groups(inventory: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Groups of two or more physical files with one content, aliases collapsed: sha256, size, keeper, files."""
    return keepers(collapse_aliases(inventory, order), order)


def ranked(inventory: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Members with their place in keeper order, 1 for the keeper. A window, for listings: its groups each sort in one task."""
    from pyspark.sql import Window

    return duplicate_members(inventory).withColumn("rank", F.row_number().over(Window.partitionBy(*CONTENT).orderBy(*(order or keeper_order()))))
