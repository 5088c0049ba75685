"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = os.path.join(tempfile.gettempdir(), "twinfold-shared")


def local_session(cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("twinfold")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in a single local process (tests) a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{_OWN}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_root(spark)}/twinfold/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "zstd", group_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage; a lost executor loses nothing of it.

    `group_rows` limits the rows of a row group: writers hold a group, and readers take up to 4,096 rows of one at once,
    however wide they are.
    """
    path = shared_path(df.sparkSession, label)
    writer = df.write.option("compression", compression)
    (writer if group_rows is None else writer.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per context."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_twinfold_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="twinfold-")) / "twinfold.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))
    context._twinfold_shipped = True
