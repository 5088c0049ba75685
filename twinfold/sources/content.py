"""Digests of listed files, read where a task can reach them; a file that changed since it was listed gives null."""

from __future__ import annotations

import hashlib
import os
import stat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.digests import WINDOW_BYTES, weak_pairs

_CHUNK = 1 << 20


def _opened(path: str, size: int):
    file = open(path, "rb", buffering=0)
    info = os.fstat(file.fileno())
    if not stat.S_ISREG(info.st_mode) or info.st_size != size:
        file.close()
        raise OSError("changed since it was listed")
    return file


@F.pandas_udf(T.StructType([T.StructField("crc32", T.LongType()), T.StructField("sum32", T.LongType()), T.StructField("error", T.StringType())]))
def _weak(paths: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    rows = []
    for path, size in zip(paths, sizes, strict=True):
        try:
            with _opened(path, int(size)) as file:
                head = b""
                while len(head) < min(int(size), WINDOW_BYTES) and (more := file.read(min(int(size), WINDOW_BYTES) - len(head))):
                    head += more
            if len(head) < min(int(size), WINDOW_BYTES):
                raise OSError("changed while it was read")
            crc, total = weak_pairs([head], [int(size)])
            rows.append((int(crc[0]), int(total[0]), None))
        except OSError as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["crc32", "sum32", "error"]).astype({"crc32": "Int64", "sum32": "Int64"})


@F.pandas_udf(T.StructType([T.StructField("sha256", T.StringType()), T.StructField("error", T.StringType())]))
def _full(paths: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    rows = []
    for path, size in zip(paths, sizes, strict=True):
        try:
            digest, seen = hashlib.sha256(), 0
            with _opened(path, int(size)) as file:
                while data := file.read(_CHUNK):
                    digest.update(data)
                    seen += len(data)
            if seen != int(size):
                raise OSError("changed while it was read")
            rows.append((digest.hexdigest(), None))
        except OSError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["sha256", "error"])


def with_weak_signature(inventory: DataFrame) -> DataFrame:
    """Adds crc32, sum32 and read_error, from the first bytes of each file."""
    return inventory.withColumn("_w", _weak("path", "size")).select(*inventory.columns, "_w.crc32", "_w.sum32", F.col("_w.error").alias("read_error"))


def with_sha256(inventory: DataFrame) -> DataFrame:
    """Adds sha256 (null if unreadable), streaming whole files of any size."""
    error: Column = F.coalesce("read_error", "_s.error") if "read_error" in inventory.columns else F.col("_s.error")
    kept = [c for c in inventory.columns if c != "read_error"]
    return inventory.withColumn("_s", _full("path", "size")).select(*kept, "_s.sha256", error.alias("read_error"))
