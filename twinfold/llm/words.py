"""Vectorised word splitting: Arrow text columns to word codes, doc offsets and a local vocabulary.

Both word definitions used here can be told from single UTF-8 bytes, so a byte table maps every separator to a
space and lower-cases A-Z; the rest is array arithmetic on the whole buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators are 20 and 09-0D; A-Z become lower case.
SPACED = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words are 0-9, a-z, A-Z (lower-cased) and all that is not ASCII.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: As SPACED, but letters keep their case.
SPACED_CASED = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def text_array(column: pa.Array) -> pa.Array:
    """The column as a large_string array without nulls (null: empty), starting at offset 0 of its buffers."""
    if column.null_count:
        column = pc.fill_null(column, "")
    return pa.concat_arrays([column.cast(pa.large_string()), pa.array([], pa.large_string())])


def text_buffer(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts as one run of UTF-8 bytes, and the n + 1 offsets into it."""
    texts = text_array(column)
    if not len(texts):
        return b"", np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b""
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most `limit` bytes of the text column (one row at least), whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def split_words(column: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """codes (one per word), bounds (n + 1, words of row i are codes[bounds[i]:bounds[i + 1]]), vocabulary (large_binary)."""
    raw, offsets = text_buffer(column)
    data = np.frombuffer(raw.translate(table), np.uint8)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), pa.array([], pa.large_binary())
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] |= inside[heads]
    at = np.flatnonzero(first)
    bounds = np.searchsorted(at, offsets)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    edges = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - at)])
    kept = data[inside]
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int32, copy=False), bounds.astype(np.int64), coded.dictionary.cast(pa.large_binary())


def hash_words(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and n + 1 bounds."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, np.int32)), pa.array(values, kind))
