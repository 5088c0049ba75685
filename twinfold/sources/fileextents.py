"""Physical extents of files by the FIEMAP ioctl (Linux), as a table; other systems bring a table of their own."""

from __future__ import annotations

import array
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from twinfold.operators.extents import clamp

# The ioctl, its flags and its batch.
_FIEMAP = 0xC020660B
_SYNC = 0x1
_BATCH = 128
_LAST, _UNKNOWN, _DELALLOC, _ENCODED, _ENCRYPTED, _INLINE, _TAIL, _SHARED = 0x1, 0x2, 0x4, 0x8, 0x80, 0x200, 0x400, 0x2000
_HEADER, _EXTENT = struct.Struct("=QQLLLL"), struct.Struct("=QQQQQLLLL")

#: A file that has no extents at all (it is sparse) is one row without a place; one whose query fails has no row.
SCHEMA = "path string, dev long, size long, logical long, physical long, length long, shared boolean, encoded boolean, opaque boolean"


def query(path: str) -> list[tuple[int, int, int, bool, bool, bool]] | None:
    """(logical, physical, length, shared, encoded, opaque) of a file, or None where the filesystem can't tell."""
    import fcntl

    out, start = [], 0
    with open(path, "rb") as file:
        while True:
            buffer = array.array("B", _HEADER.pack(start, (1 << 64) - 1 - start, _SYNC, 0, _BATCH, 0) + bytes(_EXTENT.size * _BATCH))
            try:
                fcntl.ioctl(file.fileno(), _FIEMAP, buffer, True)
            except OSError:
                return None
            mapped = _HEADER.unpack_from(buffer)[3]
            flags = 0
            for i in range(mapped):
                logical, physical, length, _, _, flags, *_ = _EXTENT.unpack_from(buffer, _HEADER.size + i * _EXTENT.size)
                place = 0 if flags & (_UNKNOWN | _DELALLOC) else physical
                out.append((logical, place, length, bool(flags & _SHARED), bool(flags & (_ENCODED | _ENCRYPTED)), bool(flags & (_INLINE | _TAIL))))
                start = logical + length
            if not mapped or flags & _LAST:
                return out


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                info, found = os.stat(path), query(path)
            except OSError:
                continue
            if found is not None:
                rows += [(path, info.st_dev, info.st_size, *x) for x in found or [(None,) * 6]]
        columns = [c.split() for c in SCHEMA.split(", ")]
        yield pd.DataFrame(rows, columns=[name for name, _ in columns]).astype({name: "Int64" if kind == "long" else "boolean" for name, kind in columns if kind != "string"})


def probed(paths: DataFrame) -> DataFrame:
    """Rows of SCHEMA for the files in column path whose extents can be told."""
    return paths.select("path").mapInPandas(_read, SCHEMA)


def extents(paths: DataFrame) -> DataFrame:
    """Extents of the files in column path, cut off at their sizes."""
    return clamp(probed(paths))


def same_storage(left: str, right: str) -> bool:
    """Whether two files on one device have the same extents, all of known places; empty and unknown layouts are not the same."""
    try:
        if os.stat(left).st_dev != os.stat(right).st_dev:
            return False
        sizes, found = [os.stat(p).st_size for p in (left, right)], [query(p) for p in (left, right)]
    except OSError:
        return False
    own = [sorted((at, place, min(length, size - at), coded, odd) for at, place, length, _, coded, odd in rows or [] if at < size) for rows, size in zip(found, sizes, strict=True)]
    return bool(own[0]) and own[0] == own[1] and all(place for _, place, *_ in own[0])
