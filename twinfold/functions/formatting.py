"""Text of reports: sizes, escaped paths, result lines, the summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_size(size: Column) -> Column:
    """N B, N kB or N MB; one decimal where the quotient is not whole, halves to even."""

    def scaled(unit: int, name: str) -> Column:
        whole = F.concat((size / F.lit(unit)).cast("bigint").cast("string"), F.lit(f" {name}"))
        tenth = F.concat(F.bround(size.cast("decimal(20,0)") / F.lit(unit).cast("decimal(10,0)"), 1).cast("decimal(20,1)").cast("string"), F.lit(f" {name}"))
        return F.when(size % unit == 0, whole).otherwise(tenth)

    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, scaled(1024, "kB")).otherwise(scaled(1048576, "MB"))


#: Control characters with a short escape, and the backslash and quote, which only a quoted path escapes.
_SHORT = {"\x07": r"\a", "\b": r"\b", "\f": r"\f", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\x0b": r"\v"}
_CONTROL = "[\\x00-\\x1f\\x7f]"


def escape_path(path: Column) -> Column:
    """The path, or if it holds a control character, its quoted form without the quotes."""
    out = F.replace(path, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    for code in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(_SHORT.get(chr(code), f"\\x{code:02x}")))
    return F.when(path.rlike(_CONTROL), out).otherwise(path)


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("; "))


def display_time(mtime: Column) -> Column:
    return F.date_format(mtime, "yyyy-MM-dd HH:mm:ss")


# The lines of results and of the summary.
_ALIAS = "    (hardlinked instances of same file)"
_DONE = {"deleted": "Deleted:    '", "hardlinked": "Hardlinked: '", "cow_cloned": "CoW cloned: '"}
_COUNTED = (
    ("zero_length_files", "files of zero length were skipped"),
    ("cant_read_files", "files could not be opened"),
    ("deleted_files", "files deleted"),
    ("hardlinked_files", "files replaced with hardlinks"),
    ("cow_cloned_files", "files replaced with CoW clones"),
    ("hardlink_groups", "hardlink groups found"),
    ("cow_groups", "CoW groups found"),
    ("skipped_ro_files", "read-only files skipped"),
    ("skipped_ref_files", "reference files skipped"),
    ("skipped_changed_files", "files skipped (changed during the scan)"),
    ("failed_files", "files could not be processed (see the log)"),
)


def report_line(keeper: Column, victim: Column, result: Column, is_alias: Column) -> Column:
    """The line or lines of one outcome; null where an outcome prints none."""
    keep, other, tick = escape_path(keeper), escape_path(victim), F.lit("'")
    pair = F.concat(F.lit("Duplicate: '"), keep, F.lit("'\nWith:      '"), other, tick, F.when(is_alias, F.lit(f"\n{_ALIAS}")).otherwise(""))
    line = F.when(result == "verified_duplicate", pair)
    for name, text in _DONE.items():
        line = line.when(result == name, F.concat(F.lit(text), other, tick))
    line = line.when(result == "skipped_ro", F.concat(F.lit("Skipping duplicate readonly file '"), other, F.lit("'.")))
    changed = F.concat(F.lit("Skipping '"), other, F.lit("' (original '"), keep, F.lit("'): one of them changed during the scan."))
    return line.when(result == "skipped_changed", changed)


def size_text(size: int) -> str:
    """format_size() of one number."""
    if size < 1024:
        return f"{size} B"
    unit, name = (1024, "kB") if size < 1048576 else (1048576, "MB")
    return f"{size // unit} {name}" if size % unit == 0 else f"{size / unit:.1f} {name}"


def summary_text(summary: dict[str, int | None]) -> list[str]:
    """The lines of a one-row summary; a counter's line only where it is above zero."""
    of = lambda name: summary.get(name) or 0
    lines = [f"{label}: {size_text(of(size)):>8} in {of(files):5d} files" for label, size, files in (("Files", "total_bytes", "total_files"), ("Dupes", "duplicate_bytes", "duplicate_files"))]
    for name, text in _COUNTED:
        tail = f" ({size_text(of('cow_shared_bytes'))} of file bytes already shared)" if name == "cow_groups" else ""
        lines += [f"  {of(name)} {text}{tail}"] if of(name) > 0 else []
    return lines
