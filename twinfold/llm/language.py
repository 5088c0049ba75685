"""Language of web pages by Bayesian evidence fusion.

Evidence, each a log likelihood per language: the text (character n-gram naive Bayes over the visible words), the
declared markup language (html lang), the address suffix (top-level domain) and a host prior. The text model is fitted
to at most `sample` documents a language (a documented bound). The other tables are counts over all pages, by grouped
aggregation of the text's own verdicts: declarations by language, suffixes by language, and hosts, their domains and
all pages by language. The host prior is smoothed hierarchically: a host's shares shrink towards its domain's, and
those towards the whole's (a domain is a host's last two labels, or three as in co.uk). A page's own verdict is taken out of every count it meets, so no text counts twice.

Tables by host and domain are pre-aggregated and joined by equi-joins that adaptive execution can split; pages
move without their text. Tables by language (declarations, suffixes) are joined too, never broadcast by force.

Defined results: null or empty html has no text evidence; a null or bad url has host, domain and suffix ""; an
undeclared language is the declaration ""; ties go to the first language in alphabetical order; without any labelled
text, languages are those declared and text says nothing; every row of pages gives one row, repeated rows and null
page_ids too; no rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.words import slices, split_words
from twinfold.session import stored

SAMPLE, MOST_CHARS = 500, 1 << 15
GRAM = 3
FEATURES = 1 << 14
#: The text's mean log likelihood counts for so many n-grams at most, as n-grams of a text depend on each other.
TEXT_WEIGHT = 40.0
#: Pseudo-counts: of all pages behind a domain, of a domain behind a host, of each language behind a table of evidence.
DOMAIN_MASS, HOST_MASS, EVIDENCE_MASS = 20.0, 10.0, 5.0

#: Elements whose content is not shown, and labels below a country's that belong to no one host.
_ELEMENTS = ("script", "style", "nav", "head")
_SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "gob", "gouv", "ne", "net", "or", "org")
_OPEN = re.compile(rf"<!--|<({'|'.join(_ELEMENTS)})\b", re.I)
_CLOSE = {None: re.compile("-->"), **{name: re.compile(rf"</{name}\s*>", re.I) for name in _ELEMENTS}}
_TAG = re.compile(r"<[^>]*>")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|\w+);")
#: Lower-case letters: what is neither an ASCII letter nor beyond ASCII parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # languages x features, log probabilities


def visible(html: str | None) -> str:
    """The text a reader sees: no comments, scripts, styles, heads, navigation, tags or entities.

    One scan forward: what opens and never closes hides nothing, and its close is looked for once."""
    html, shown, at, open_for_good = html or "", [], 0, set()
    for m in _OPEN.finditer(html):
        kind = m.group(1) and m.group(1).lower()
        if m.start() < at or kind in open_for_good:
            continue
        end = _CLOSE[kind].search(html, m.end())
        if end is None:
            open_for_good.add(kind)
            continue
        shown += [html[at : m.start()], " "]
        at = end.end()
    text = "".join([*shown, html[at:]])
    last = text.rfind(">") + 1  # no tag closes after it
    return _ENTITY.sub(" ", _TAG.sub(" ", text[:last]) + text[last:])


def gram_codes(texts: list[str], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of each text's words (a space before and after each), flat, and bounds."""
    codes, bounds, words = split_words(pa.array(texts, pa.string()), _LETTERS)
    own = []
    for word in words.to_pylist():
        data = np.frombuffer(b" " + word + b" ", np.uint8).astype(np.uint64)
        value = np.zeros(max(1, len(data) - GRAM + 1), np.uint64)
        for j in range(GRAM):
            value = value * np.uint64(0x100000001B3) + data[j : j + len(value)] + np.uint64(1)
        own.append(((value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(features))
    sizes = np.array([len(x) for x in own], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)
    count = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    to = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.repeat(first[codes] - to[:-1], count) + np.arange(to[-1]) if len(codes) else np.zeros(0, np.int64)
    return flat[at], to[bounds]


def sampled(docs: DataFrame, sample: int = SAMPLE, most_chars: int = MOST_CHARS) -> DataFrame:
    """(lang, text) of at most `sample` documents of each language: those of the smallest hashes.

    Hashes are counted by language and first 16 bits; only documents up to the bits that the sample's last hash has are
    ranked, so no language is one hot group."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("lang"))
    usable = rows.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND lang <> ''").filter(F.length("text").between(1, most_chars)).withColumn("h", F.xxhash64("doc_id"))
    usable = usable.withColumn("bits", F.call_function("shiftright", F.col("h"), F.lit(48)))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("bits")) - F.col("n")  # 65,536 rows a language at most
    last = usable.groupBy("lang", "bits").agg(F.count("*").alias("n")).withColumn("below", below).filter(F.col("below") < sample).groupBy("lang").agg(F.max("bits").alias("last"))
    near = usable.join(last, "lang").filter("bits <= last")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= sample).select("lang", "text")


def _tables(table: pa.Table) -> pa.Table:
    counts = np.bincount(gram_codes(table.column("text").to_pylist())[0], minlength=FEATURES)
    return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.ListArray.from_arrays(pa.array([0, FEATURES], pa.int32()), pa.array(counts.astype(np.int64)))})


def fit_text(docs: DataFrame, sample: int = SAMPLE, most_chars: int = MOST_CHARS) -> TextModel:
    """Fit to at most `sample` documents (of at most `most_chars` characters, smallest hash first) of each language in docs (doc_id, text, lang)."""
    rows = sampled(docs, sample, most_chars).groupBy("lang").applyInArrow(_tables, "lang string, counts array<long>").collect()  # one row a language
    rows.sort(key=lambda r: r["lang"])
    table = np.ones((len(rows), FEATURES)) + np.array([r["counts"] for r in rows], float).reshape(-1, FEATURES)
    return TextModel([r["lang"] for r in rows], np.log(table / table.sum(1, keepdims=True)))


def _read(batches: Iterator[pa.RecordBatch], held: object) -> Iterator[pa.RecordBatch]:
    model = held.value
    n = len(model.languages)
    for block in slices(batches, "html", 8 << 20):
        codes, bounds = gram_codes([visible(x) for x in block.column(1).to_pylist()])
        sizes = np.diff(bounds)
        score = np.zeros((block.num_rows, n))
        full = np.flatnonzero(sizes)
        for k in range(n if len(full) else 0):
            score[full, k] = np.add.reduceat(model.table[k][codes], bounds[:-1][full]) / sizes[full]
        score *= np.minimum(sizes, TEXT_WEIGHT)[:, None]
        best = [model.languages[i] if s else None for i, s in zip(score.argmax(1).tolist() if n else [0] * len(sizes), sizes.tolist(), strict=True)] if n else [None] * block.num_rows
        text = pa.ListArray.from_arrays(pa.array(np.arange(block.num_rows + 1) * n, pa.int32()), pa.array(score.reshape(-1)))
        yield pa.RecordBatch.from_arrays([block.column(0), *(block.column(i) for i in range(2, 6)), pa.array(best, pa.string()), text], names=["page_id", "declared", "host", "domain", "suffix", "verdict", "text_score"])


def _address(url: Column) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return {
        "host": host,
        "domain": F.regexp_extract(host, rf"((?:[^.]+\.(?:{'|'.join(_SECOND_LEVEL)})\.[a-z][a-z]|[^.]+\.[^.]+))$", 1),
        "suffix": F.regexp_extract(host, r"\.([^.]+)$", 1),
    }


def _counts(pages: DataFrame, by: list[str], languages: list[str], name: str) -> DataFrame:
    """An array of verdict counts, in the order of languages, per key."""
    sums = [F.sum((F.col("verdict") == language).cast("long")) for language in languages]
    return pages.groupBy(*by).agg(F.array(*(F.coalesce(s, F.lit(0).cast("long")) for s in sums)).alias(name))


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, language, confidence, text_language, declared, host of every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    model = fit_text(docs, sample)
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    declared = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^<>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("html"), declared.alias("declared"), *(c.alias(n) for n, c in _address(url).items()))
    if not model.languages:
        names = sorted(r["declared"] for r in rows.filter("declared <> ''").select("declared").distinct().collect())  # two or three letters each
        model = TextModel(names, np.full((len(names), FEATURES), -np.log(FEATURES)))
    held = spark.sparkContext.broadcast(model)
    read = stored(rows.mapInArrow(lambda it: _read(it, held), "page_id long, declared string, host string, domain string, suffix string, verdict string, text_score array<double>"), "pages")
    languages = model.languages
    n = len(languages)
    if not n:
        return read.select("page_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.col("verdict").alias("text_language"), "declared", "host")
    whole = _counts(read, [], languages, "all_n").first()["all_n"]
    by_host = stored(_counts(read, ["host", "domain"], languages, "host_n"), "hosts")
    add = [F.sum(F.get("host_n", F.lit(k))) for k in range(n)]
    by_domain = by_host.groupBy("domain").agg(F.array(*add).alias("domain_n"))
    hosts = stored(by_host.join(by_domain, "domain").select("host", "host_n", "domain_n"), "priors")
    by_declared = stored(_counts(read, ["declared"], languages, "declared_n"), "declared")
    by_suffix = stored(_counts(read, ["suffix"], languages, "suffix_n"), "suffixes")
    joined = read.join(hosts, "host").join(by_declared, "declared").join(by_suffix, "suffix")

    kinds = [by_declared.count(), by_suffix.count()]
    own = [(F.col("verdict").eqNullSafe(F.lit(language))).cast("double") for language in languages]
    total = float(sum(whole))

    def evidence(name: str, kinds: int) -> list[Column]:
        """log P(value | language), the page itself left out, smoothed evenly over the kinds of value."""
        return [F.log((F.get(name, F.lit(k)) - own[k] + EVIDENCE_MASS / kinds) / (F.lit(float(whole[k])) - own[k] + EVIDENCE_MASS)) for k in range(n)]

    mine = F.when(F.col("verdict").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    overall = [(F.lit(float(whole[k])) - own[k] + 1.0) / (F.lit(total) - mine + n) for k in range(n)]
    summed = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)
    domain = [(F.get("domain_n", F.lit(k)) - own[k] + DOMAIN_MASS * overall[k]) / (summed("domain_n") - mine + DOMAIN_MASS) for k in range(n)]
    host = [(F.get("host_n", F.lit(k)) - own[k] + HOST_MASS * domain[k]) / (summed("host_n") - mine + HOST_MASS) for k in range(n)]
    told, suffix = evidence("declared_n", max(1, kinds[0])), evidence("suffix_n", max(1, kinds[1]))
    logs = F.array(*(F.get("text_score", F.lit(k)) + told[k] + suffix[k] + F.log(host[k]) for k in range(n)))
    scored = joined.withColumn("_logs", logs).withColumn("_best", F.array_max("_logs"))
    mass = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    names = F.array(*map(F.lit, languages))
    return scored.select(
        "page_id",
        F.get(names, (F.array_position("_logs", F.col("_best")) - 1).cast("int")).alias("language"),
        (F.lit(1.0) / mass).alias("confidence"),
        F.col("verdict").alias("text_language"),
        "declared",
        "host",
    )
