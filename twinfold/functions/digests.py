"""Weak signature and content digests.

The weak signature folds the first `window_bytes` bytes into two 32-bit values and adds the size to the second. It is
a recurrence over bytes, so it is one Arrow UDF that walks many rows of a batch together: texts are right-aligned in
a (rows, window) table, where leading zero bytes leave the all-zero state as it is. Only heads are sent to Python, and
are read in place from the Arrow buffer there: a worker holds a batch and one table. SHA-256 is Spark's own sha2().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: bytes that the weak signature reads.
WINDOW_BYTES = 32768
#: Bytes in the table that a batch is cut into.
_TABLE_BYTES = 8 << 20
#: Places of the table that are turned and widened at once.
_PLACES = 64


def weak_pairs(contents: list[bytes], sizes: list[int], window_bytes: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(crc32, sum32) of each content, as non-negative 64-bit integers. Their order as a pair is the signature's order."""
    heads = pa.array([c[:window_bytes] for c in contents], pa.large_binary())
    return _signed(heads, np.array([s & 0xFFFFFFFF for s in sizes], np.int64))


def _signed(heads: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(crc32, sum32) of contents of which `heads` is all that counts but the sizes; a null is empty."""
    crc, total = np.zeros(len(heads), np.uint32), np.zeros(len(heads), np.uint32)
    _, offsets, data = heads.buffers()
    kind = np.int64 if pa.types.is_large_binary(heads.type) else np.int32
    edges = np.frombuffer(offsets, kind)[heads.offset : heads.offset + len(heads) + 1] if len(heads) else np.zeros(1, kind)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for run in _batches(np.diff(edges)):
        crc[run], total[run] = _folded(raw, edges[:-1][run], edges[1:][run])
    total += sizes.astype(np.uint32)
    return crc.astype(np.int64), total.astype(np.int64)


def _folded(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = int((ends - starts).max(initial=0))
    table = np.zeros((len(starts), width), np.uint8)
    for row, start, end in zip(table, starts.tolist(), ends.tolist(), strict=True):
        row[width - (end - start) :] = raw[start:end]
    crc, total = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32)
    for first in range(0, width, _PLACES):
        for byte in table[:, first : first + _PLACES].T.astype(np.uint32, order="C"):
            crc ^= byte
            total += byte
            low = crc & np.uint32(255)
            crc = (crc >> np.uint32(8)) ^ (low << np.uint32(24)) ^ (low << np.uint32(9))
            total = (total << np.uint32(1)) | (total >> np.uint32(31))
    return crc, total


def _batches(lengths: np.ndarray) -> list[np.ndarray]:
    """Rows in order of length, in runs whose table stays small."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order].tolist()
    runs, first = [], 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i + 1 - first) * max(1, ordered[i]) > _TABLE_BYTES or ordered[i - 1] * 4 < ordered[i]:
            runs.append(order[first:i])
            first = i
    return runs


def weak_signature(content: Column, size: Column | None = None, window_bytes: int = WINDOW_BYTES) -> Column:
    """struct(crc32, sum32) of a binary column; `size` overrides its own length. Null content gives null."""

    @F.arrow_udf("crc32 long, sum32 long")
    def signature(heads: pa.Array, sizes: pa.Array) -> pa.Array:
        crc, total = _signed(heads, sizes.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(crc), pa.array(total)], names=["crc32", "sum32"])

    binary = content.cast("binary")
    own = F.octet_length(binary)
    pair = signature(F.substring(binary, 1, window_bytes), (own if size is None else F.coalesce(size, own)).cast("long"))
    return F.when(binary.isNotNull(), pair)


def signature_hex(crc32: str | Column = "crc32", sum32: str | Column = "sum32") -> Column:
    """The 64-bit signature as 16 hex digits."""
    digits = [F.lpad(F.lower(F.hex(c)), 8, "0") for c in (crc32, sum32)]
    return F.concat(*digits)


def content_digest(content: Column) -> Column:
    """SHA-256 as lowercase hex; its string order is its byte order."""
    return F.sha2(content.cast("binary"), 256)
