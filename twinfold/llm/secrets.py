"""Secret scan with DataFrame functions only: patterns, and sliding-window entropy of candidate strings.

Pattern kinds give the leftmost non-overlapping matches; those that are too short are dropped. Splitting a text at a
pattern gives the text between its matches, so the lengths of both, summed up, give every match's place.

The entropy kind finds what no pattern names. Candidates are runs of `CANDIDATE` of at least `WINDOW` characters;
each belongs to the first character class that holds all its characters. A window of `WINDOW` characters slides over
the candidate. The counts of the characters in it are kept up to date: one count goes up and one goes down at each
step, and with them the sum of c * log2(c), in whole units of 2 ** -20 bit so that no rounding adds up. A window is
hot if its Shannon entropy, log2(w) - sum / w, reaches the class's threshold; the span runs from the first hot
window's start to the last one's end. Candidates that match the allow-list and spans that touch a pattern's span are
suppressed. Pattern spans are never suppressed.

Defined results: a null text is empty; places count code points, ends are exclusive; every row gives one row, repeated
rows and null doc_ids too; texts without secrets have empty lists; places and candidates cover whole texts of any
length: entropy takes time in proportion to a candidate's length, and sums over places work in blocks of about the square
root of the number of matches; no rows give no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, the group whose length counts, its least length.
PATTERNS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
ENTROPY = "entropy"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character class, its pattern, the least entropy in bits of a hot window.
CLASSES = (("hex", r"^[0-9A-Fa-f]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.6), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8))
#: Candidates that are no secrets: words and paths of words, rules of one character, numbers, UUIDs, placeholders.
ALLOWED = (
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|xxxxxxxx|your[_-]?(?:key|token|secret)",
    r"(?i)0123456789abcdef|abcdefghijklmnop",
)
UNIT = 1 << 20
#: c * log2(c) for the counts a window can hold, in units.
PLOGP = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]
#: Characters of candidates lie between "+" (43) and "z" (122): 80 counts of at most WINDOW, packed into words of IN_WORD.
LOW, BITS, IN_WORD, WORDS = 43, 5, 12, 7
#: Windows of a candidate that are gone through in one piece; a piece starts its counts anew.
PIECE = 4096

SPAN = "array<struct<start:int,rank:int,end:int>>"


def _running(steps: Column) -> Column:
    """Sums of all earlier elements; an array of the same size."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(steps, start, lambda a, x: F.struct(F.concat(a["out"], F.array(a["at"])).alias("out"), (a["at"] + x).alias("at")), lambda a: a["out"])


def _total(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _places(text: Column, pattern: str) -> Column:
    """struct(start, text) of the matches of a text that has one at least."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.struct(F.transform(gaps, F.length).alias("gaps"), found.alias("found"))


def _starts(df: DataFrame, name: str) -> DataFrame:
    """Adds `<name>_start`, the matches' places, from struct column `name` (null: no match)."""
    gaps, found = F.col(f"{name}.gaps"), F.col(f"{name}.found")
    width = F.ceil(F.sqrt(F.size(found))).cast("int")
    df = df.withColumn("_steps", F.when(F.col(name).isNotNull(), F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.length(m))))
    df = df.withColumn("_blocks", F.when(F.col("_steps").isNotNull(), F.transform(F.sequence(F.lit(0), ((F.size("_steps") - 1) / width).cast("int")), lambda j: F.slice("_steps", j * width + 1, width))))
    df = df.withColumn("_before", _running(F.transform("_blocks", _total)))
    inside = F.flatten(F.zip_with("_blocks", "_before", lambda b, before: F.transform(_running(b), lambda x: x + before)))
    df = df.withColumn(f"{name}_start", F.zip_with(inside, F.slice(gaps, 1, F.size(found)), lambda a, g: a + g))
    return df.drop("_steps", "_blocks", "_before")


def _pattern_spans(df: DataFrame, rank: int) -> DataFrame:
    kind, pattern, group, least = PATTERNS[rank]
    text = F.col("text")
    df = df.withColumn("_m", F.when(text.rlike(pattern), _places(text, pattern)))
    df = df.withColumn("_v", F.when(F.col("_m").isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))
    df = _starts(df, "_m")
    all_spans = F.transform(
        F.arrays_zip(F.col("_m_start").alias("s"), F.col("_m.found").alias("m"), F.col("_v").alias("v")),
        lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), (x["s"] + F.length(x["m"])).alias("end"), F.length(x["v"]).alias("size")),
    )
    kept = F.transform(F.filter(all_spans, lambda x: x["size"] >= least), lambda x: F.struct(x["start"], x["rank"], x["end"]))
    return df.withColumn(kind, F.coalesce(kept.cast(SPAN), F.array().cast(SPAN))).drop("_m", "_v", "_m_start")


def _pieces(candidate: Column) -> Column:
    """A candidate's windows in pieces of at most PIECE: struct(first window, characters)."""
    blocks = F.regexp_extract_all(candidate, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    tails = F.concat(F.transform(F.slice(blocks, 2, F.size(blocks)), lambda b: F.substring(b, 1, WINDOW - 1)), F.array(F.lit("")))
    joined = F.zip_with(blocks, tails, lambda b, t: F.concat(b, t))
    return F.transform(joined, lambda t, j: F.struct((j * PIECE).alias("first"), F.transform(F.split(t, "", -1), F.ascii).alias("codes")))


def _steps(codes: Column) -> Column:
    """For each character that enters: the word and the bits of the packed counts it has, and those of the one that leaves (word -1: none)."""
    slots = F.transform(F.filter(codes, lambda c: c >= LOW), lambda c: c - LOW)
    left = F.concat(F.array_repeat(F.lit(-1), WINDOW), slots)
    word, shift = lambda s: F.floor(s / IN_WORD).cast("int"), lambda s: (s % IN_WORD * BITS).cast("int")
    pairs = F.zip_with(slots, F.slice(left, 1, F.size(slots)), lambda e, l: F.struct(e.alias("e"), l.alias("l")))
    return F.transform(
        pairs,
        lambda x, i: F.struct(
            i.alias("i"),
            word(x["e"]).alias("ew"),
            shift(x["e"]).alias("es"),
            F.when(x["l"] >= 0, word(x["l"])).otherwise(-1).alias("lw"),
            F.when(x["l"] >= 0, shift(x["l"])).otherwise(0).alias("ls"),
            (x["e"] == x["l"]).cast("int").alias("same"),
        ),
    )


def _hot(steps: Column, most: Column) -> Column:
    """struct(first, last) windows of a piece whose sum of c * log2(c) is at most `most` units; first is -1 if none is.

    A step takes the leaving character out of the counts and the entering one in, and with them changes the sum; the
    window that the step before completed is judged by the sum it left, so that nothing is worked out twice."""
    gain = F.array(*(F.lit(PLOGP[c + 1] - PLOGP[c]) for c in range(WINDOW)))
    one = F.lit(1).cast("long")
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), WORDS).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("n"))

    def shifted(value: Column, by: Column, left: bool) -> Column:
        return F.call_function("shiftleft" if left else "shiftright", value, by)

    def count(a: Column, word: Column, shift: Column) -> Column:
        return shifted(F.get(a["counts"], word), shift, False).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")

    def judged(a: Column) -> tuple[Column, Column]:
        hot = (a["n"] >= WINDOW) & (a["sum"] <= most)
        at = a["n"] - WINDOW
        return F.when(hot & (a["first"] < 0), at).otherwise(a["first"]), F.when(hot, at).otherwise(a["last"])

    def step(a: Column, x: Column) -> Column:
        loss = F.when(x["lw"] >= 0, F.get(gain, count(a, x["lw"], x["ls"]) - 1)).otherwise(0)
        counts = F.transform(
            a["counts"],
            lambda c, k: c + F.when(k == x["ew"], shifted(one, x["es"], True)).otherwise(0) - F.when(k == x["lw"], shifted(one, x["ls"], True)).otherwise(0),
        )
        first, last = judged(a)
        total = a["sum"] + F.get(gain, count(a, x["ew"], x["es"]) - x["same"]) - loss
        return F.struct(counts.alias("counts"), total.cast("long").alias("sum"), first.alias("first"), last.alias("last"), (x["i"] + 1).alias("n"))

    def finish(a: Column) -> Column:
        first, last = judged(a)
        return F.struct(first.alias("first"), last.alias("last"))

    return F.aggregate(steps, start, step, finish)


def _entropy_spans(df: DataFrame) -> DataFrame:
    text, rank = F.col("text"), len(PATTERNS)
    df = _starts(df.withColumn("_m", F.when(text.rlike(CANDIDATE), _places(text, CANDIDATE))), "_m")

    def limit(m: Column) -> Column:
        out = F.lit(None).cast("long")
        for _, pattern, bits in reversed(CLASSES):
            out = F.when(m.rlike(pattern), F.lit(math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)).cast("long")).otherwise(out)
        return out

    def allowed(m: Column) -> Column:
        out = F.lit(False)
        for pattern in ALLOWED:
            out = out | m.rlike(pattern)
        return out

    zipped = F.arrays_zip(F.col("_m_start").alias("s"), F.col("_m.found").alias("m"))
    searched = F.filter(zipped, lambda x: ~allowed(x["m"]))
    pieces = F.transform(searched, lambda x: F.struct(x["s"].alias("s"), limit(x["m"]).alias("most"), _pieces(x["m"]).alias("pieces")))
    found = F.transform(pieces, lambda x: F.struct(x["s"].alias("s"), F.transform(x["pieces"], lambda p: F.struct(p["first"].alias("at"), _hot(_steps(p["codes"]), x["most"]).alias("h"))).alias("h")))
    hot = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.filter(x["h"], lambda p: p["h"]["first"] >= 0).alias("h")))
    spans = F.transform(
        F.filter(hot, lambda x: F.size(x["h"]) > 0),
        lambda x: F.struct(
            (x["s"] + F.element_at(x["h"], 1)["at"] + F.element_at(x["h"], 1)["h"]["first"]).alias("start"),
            F.lit(rank).alias("rank"),
            (x["s"] + F.element_at(x["h"], -1)["at"] + F.element_at(x["h"], -1)["h"]["last"] + WINDOW).alias("end"),
        ),
    )
    df = df.withColumn("_spans", F.coalesce(spans.cast(SPAN), F.array().cast(SPAN))).drop("_m", "_m_start")
    return _clear(df).drop("_spans")


def _clear(df: DataFrame) -> DataFrame:
    """The spans that touch no base span: in order of base starts and span ends, the furthest base end before each is at most the span's start."""
    event = lambda at, kind, x: F.struct(at.alias("at"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    touching = (F.size("_spans") > 0) & (F.size("base") > 0)
    events = F.array_sort(F.concat(F.transform("_spans", lambda x: event(x["end"], 0, x)), F.transform("base", lambda x: event(x["start"], 1, x))))
    df = df.withColumn("_events", F.when(touching, events))
    width = F.ceil(F.sqrt(F.size("_events"))).cast("int")
    df = df.withColumn("_blocks", F.when(touching, F.transform(F.sequence(F.lit(0), ((F.size("_events") - 1) / width).cast("int")), lambda j: F.slice("_events", j * width + 1, width))))
    reach = lambda x: F.when(x["kind"] == 1, x["end"]).otherwise(-1)
    df = df.withColumn("_before", _furthest(F.transform("_blocks", lambda b: F.array_max(F.transform(b, reach)))))
    inside = F.zip_with("_blocks", "_before", lambda b, before: F.zip_with(b, _furthest(F.transform(b, reach)), lambda x, r: F.struct(x.alias("x"), F.greatest(r, before).alias("r"))))
    kept = F.filter(F.flatten(inside), lambda x: (x["x"]["kind"] == 0) & (x["r"] <= x["x"]["start"]))
    clear = F.transform(kept, lambda x: F.struct(x["x"]["start"].alias("start"), F.lit(len(PATTERNS)).alias("rank"), x["x"]["end"].alias("end")))
    return df.withColumn(ENTROPY, F.when(touching, clear.cast(SPAN)).otherwise(F.col("_spans"))).drop("_events", "_blocks", "_before")


def _furthest(ends: Column) -> Column:
    """The largest of all earlier elements; an array of the same size."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("at"))
    return F.aggregate(ends, start, lambda a, x: F.struct(F.concat(a["out"], F.array(a["at"])).alias("out"), F.greatest(a["at"], x).alias("at")), lambda a: a["out"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, one list of spans (start, rank, end) per kind, `base` (all pattern spans) and `spans` (all), both by start, then kind."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for rank in range(len(PATTERNS)):
        df = _pattern_spans(df, rank)
    df = df.withColumn("base", F.array_sort(F.concat(*(F.col(p[0]) for p in PATTERNS))))
    df = _entropy_spans(df)
    return df.withColumn("spans", F.array_sort(F.concat("base", ENTROPY))).drop("text")


def joined(spans: str) -> Column:
    """kind:start:end of a list of spans, comma-joined."""
    kinds = F.array(*(F.lit(p[0]) for p in PATTERNS), F.lit(ENTROPY))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
