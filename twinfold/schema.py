"""Column layouts and the fixed vocabularies of results and actions."""

from __future__ import annotations

from pyspark.sql import types as T

_text, _long, _flag = T.StringType(), T.LongType(), T.BooleanType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: One row per path. Unknown values are null: a digest not computed, an identity not available.
INVENTORY = _of(
    path=_text, size=_long, mtime_ns=_long, mtime=T.TimestampType(), dev=_long, inode=_long, num_links=_long, is_ref=_flag,
    crc32=_long, sum32=_long, sha256=_text, compressed=_flag, read_only=_flag, identity_error=_text,
)
SCAN_ERRORS = _of(path=_text, pattern=_text, kind=_text, message=_text)
EXTENTS = _of(path=_text, dev=_long, logical=_long, physical=_long, length=_long, shared=_flag, encoded=_flag, opaque=_flag)
LIVE_STATE = _of(path=_text, exists=_flag, is_regular=_flag, size=_long, mtime_ns=_long, dev=_long, inode=_long, read_only=_flag)
CHOICES = _of(sha256=_text, size=_long, keep_path=_text)

#: What a run does with victims, and what became of each.
REPORT, DELETE, HARDLINK, COW = ACTIONS = ("report", "delete", "hardlink", "cow")
RESULTS = (
    "verified_duplicate", "already_hardlinked", "deleted", "hardlinked", "cow_cloned", "skipped_ro", "skipped_ref",
    "hardlink_limit", "error", "already_shared", "skipped_changed", "skipped_cross_device",
)
#: Results that say nothing about duplicated storage.
NOT_DUPLICATED = ("already_hardlinked", "already_shared", "skipped_changed")
