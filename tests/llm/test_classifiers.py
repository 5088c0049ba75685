"""Quality, licenses, language."""

import random
import zlib

import pytest
from helpers import ODD, SCHEMA, clashing, words

from twinfold.llm import language, licenses, quality, queries

LABELS = "doc_id long, quality int"


def labelled(seed=4, n=240):
    rng = random.Random(seed)
    good = lambda: " ".join(rng.choice(["the", "river", "flows", "under", "old", "stone", "bridges", "at", "night"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "!!!", "$$$", "CLICK", "###", "FREE"]) for _ in range(60))
    docs = [(i, good() if i % 3 else bad()) for i in range(n)]
    return docs, [(i, int(i % 3 > 0)) for i in range(n)]


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled()
    df = clashing(spark.createDataFrame(docs + ODD, SCHEMA))
    model = quality.fit(df, spark.createDataFrame(labels, LABELS), queries._remainder(4) != 2)
    got = quality.score(df, model).select("doc_id", "score").collect()
    assert len(got) == len(docs) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["score"]) for r in got if (r["doc_id"] or 0) >= 12 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 30 and sum((s >= quality.THRESHOLD) == bool(q) for q, s in held) / len(held) > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(999, 0), (998, None)]])
def test_quality_without_both_classes(spark, labels):
    df = spark.createDataFrame(ODD, SCHEMA)
    model = quality.fit(df, spark.createDataFrame(labels, LABELS))
    scores = {r["score"] for r in quality.score(df, model).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1
    assert quality.score(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_quality_features_are_sizes_of_blocks():
    """Features and scores from plain zstandard calls, block by block."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    rng = random.Random(8)
    good, bad = (b" ".join(rng.choice(w) for _ in range(900)) for w in ([b"house", b"garden", b"winter"], [b"click", b"buy", b"cheap"]))
    model = quality.Model(good, bad, [0.3, 1.2, -0.4, 0.7], block=500)
    texts = ["", "click buy cheap " * 90, "house garden winter", "é" * 700]

    def size(dictionary, block):
        own = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return len(own.compress(block))

    class Held:
        value = model

    (out,) = quality._score(iter([pa.record_batch({"text": pa.array(texts)})]), Held, "score")
    for text, score in zip(texts, out.column("score").to_pylist(), strict=True):
        raw = text.encode()
        difference = sum(size(bad, raw[i : i + 500]) - size(good, raw[i : i + 500]) for i in range(0, len(raw), 500)) / (len(raw) + 64)
        small = 64 / (len(raw) + 64)
        odds = 0.3 + 1.2 * 10 * difference - 0.4 * small + 0.7 * 10 * difference * small
        assert abs(score - 1 / (1 + np.exp(-odds))) < 1e-9


def test_calibration_keeps_the_shares_of_classes():
    import numpy as np

    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.9).astype(int)
    x = rng.normal(size=4000) + y
    sample = np.concatenate([np.flatnonzero(y == q)[:300] for q in (0, 1)])  # as many of each
    terms = np.column_stack([np.ones(4000), x])
    whole = quality._logistic(terms, y.astype(float), quality.class_weights(y, {0: int((y == 0).sum()), 1: int(y.sum())}))
    part = quality._logistic(terms[sample], y[sample].astype(float), quality.class_weights(y[sample], {0: int((y == 0).sum()), 1: int(y.sum())}))
    plain = quality._logistic(terms[sample], y[sample].astype(float), np.ones(len(sample)))
    assert abs(whole[0] - part[0]) < 0.4 < abs(whole[0] - plain[0])


def test_quality_query_never_learns_from_held_out_labels(spark):
    docs = [(i, "x" * (i + 1)) for i in range(40)]
    unseen = [(i, 0) for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    model = quality.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(unseen, LABELS), queries._remainder(4) != 2)
    assert model == quality.Model(b"", b"", [0.0])


def test_patience_and_subsequence():
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    text, template = "x a b y b c z d".split(), "a b c d".split()
    pairs = licenses.patience(text, template)
    assert [text[i] for i, _ in pairs] == [template[j] for _, j in pairs] and pairs == sorted(pairs)
    assert len(licenses.patience(template, template)) == 4 and licenses.patience([], template) == []
    assert licenses.densest([0, 1, 2, 50]) == (3, 0, 3)


def test_increasing_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        values = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
        best = 0
        for mask in range(1 << len(values)):
            own = [v for i, v in enumerate(values) if mask >> i & 1]
            best = max(best, len(own)) if all(a < b for a, b in zip(own[:-1], own[1:], strict=True)) else best
        found = [values[i] for i in licenses.increasing(values)]
        assert len(found) == best and all(a < b for a, b in zip(found[:-1], found[1:], strict=True))


def test_licenses(spark):
    filler = "some other words that say nothing at all of it " * 30
    mit = licenses.TEMPLATES["MIT"]
    rows = [
        (100, filler + mit + filler),
        (101, filler + "Released under the MIT License. " + filler + "Licensed under CC BY-NC 4.0."),
        (102, filler + mit.replace("Software", "Library") + filler),
        (103, filler),
        (104, " ".join(w for i, w in enumerate(mit.split()) if i % 3)),
        (105, ("Released under the MIT License. " + filler) * 2),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(clashing(spark.createDataFrame(rows + ODD, SCHEMA))).collect() if (r["doc_id"] or 0) >= 100}
    names = {k: [x["name"] for x in v] for k, v in got.items()}
    assert names[100] == ["MIT"] and names[103] == [] and names[104] == []
    assert names[101] == ["MIT notice", "CC-BY-NC-4.0 notice"] and names[102] == ["MIT"] and names[105] == ["MIT notice"] * 2
    found = got[100][0]
    assert words(rows[0][1])[found["start"] : found["end"]] == words(mit) and found["coverage"] == 1.0
    assert 0.9 < got[102][0]["coverage"] < 1
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_licenses(spark):
    """Copies side by side or many times over, whole or edited, with words before and after."""
    mit, notice = licenses.TEMPLATES["MIT"], "Released under the MIT License. "
    edited = mit.replace("persons", "people").replace("without limitation", "with no limit")
    texts = [
        (f"The code: {notice}{notice}End", ["MIT notice"] * 2),
        (f"Copyright 2020 A. {mit} Copyright 2021 B. {mit} end", ["MIT"] * 2),
        (f"of the code {edited} of the rest {edited} the end of the text", ["MIT"] * 2),
        ("the start " + f"{mit} file of the code " * 30 + "the end", ["MIT"] * 30),
        ("the start " + f"{notice}of the " * 30 + "the end", ["MIT notice"] * 30),
        ("of the software and to the License " * 200, []),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], SCHEMA)).collect()}
    for i, (text, names) in enumerate(texts):
        assert [x["name"] for x in got[i]] == names
        own = words(text)
        for x in got[i]:
            whole = words(licenses.TEMPLATES[x["name"]])
            assert x["coverage"] >= 0.9 and (x["coverage"] < 1 or own[x["start"] : x["end"]] == whole)
    assert all(x["coverage"] == 1 for i in (0, 1, 3, 4) for x in got[i])


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the Apache License.", []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0 short"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0 notice"]),
        ("Licensed under CC BY-NC-SA 4.0.", []),
        ("Licensed under the Apache License, Version 1.0", []),
        ("Licensed under the Apache License, Version 2.0", ["Apache-2.0 notice"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0 notice"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0 notice"]),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", []),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", []),
        (licenses.TEMPLATES["BSD-3-Clause"], ["BSD-3-Clause"]),
        (licenses.TEMPLATES["Apache-2.0 header"], ["Apache-2.0 header"]),
        (licenses.TEMPLATES["GPL-2.0 header"], ["GPL-2.0 header"]),
        (licenses.TEMPLATES["GPL-3.0 header"] + " Released under the MIT License.", ["GPL-3.0 header", "MIT notice"]),
        (licenses.TEMPLATES["GPL-3.0 header"].replace("GNU General", "GNU Lesser General"), []),
    ],
)
def test_licenses_that_differ_in_a_word(text, names):
    import pyarrow as pa

    for own in (text, "Some words before it. " + text + " And some words after it."):
        (out,) = licenses._scan(iter([pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([own])})]), licenses.TEMPLATES, licenses.COVERAGE)
        assert [x["name"] for x in out.column("licenses")[0].as_py()] == names


def test_every_template_is_found():
    import pyarrow as pa

    names = sorted(licenses.TEMPLATES)
    batch = pa.record_batch({"doc_id": pa.array(range(len(names))), "text": pa.array([f"x {licenses.TEMPLATES[n]} y" for n in names])})
    (out,) = licenses._scan(iter([batch]), licenses.TEMPLATES, licenses.COVERAGE)
    assert [[x["name"] for x in row] for row in out.column("licenses").to_pylist()] == [[n] for n in names]


def test_licenses_against_all_windows():
    """Short notices in shuffled words: whatever any window of the text holds is found, and all that is found is held by its window."""
    import pyarrow as pa

    rng = random.Random(21)
    names = ["MIT notice", "CC-BY-NC-4.0 notice", "CC-BY-4.0 short", "Apache-2.0 notice"]
    templates = {n: licenses.TEMPLATES[n] for n in names}
    pool = [w for n in names for w in words(templates[n])] + ["x", "y"]

    def held(own, name):
        """Whether the words, as a window from end to end, are a finding of the template."""
        wanted = words(templates[name])
        pairs = licenses.patience(own, wanted)
        rule = licenses.rule_of(name, templates[name])
        return len(pairs) >= 0.8 * len(wanted) and len(pairs) / len(own) >= licenses.DENSITY and rule.holds([w.encode() for w in own])

    for _ in range(60):
        own = []
        while len(own) < 30:
            own += [w for w in words(templates[rng.choice(names)]) if rng.random() < 0.93] if rng.random() < 0.6 else [rng.choice(pool)]
        (out,) = licenses._scan(iter([pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([" ".join(own)])})]), templates, 0.8)
        found = out.column("licenses")[0].as_py()
        for x in found:
            assert held(own[x["start"] : x["end"]], x["name"]) or x["coverage"] >= 0.8
            assert licenses.rule_of(x["name"], templates[x["name"]]).holds([w.encode() for w in own[x["start"] : x["end"]]])
        for name in names:
            spans = [(i, j) for i in range(len(own)) for j in range(i + 1, min(len(own), i + 13) + 1) if held(own[i:j], name)]
            mine = [x for x in found if x["name"] == name]
            if spans and not mine:  # then each lies in, or overlaps, a finding of another template
                assert any(x["start"] < j and i < x["end"] for x in found for i, j in spans)
            assert not mine or spans


def test_regions_keep_every_dense_stretch():
    import numpy as np

    rng = np.random.default_rng(5)
    inside, bounds = rng.random(300) < 0.3, np.array([0, 120, 120, 300])
    found = licenses.regions(inside, bounds, 10, 6)
    for row in range(3):
        for a in range(bounds[row], bounds[row + 1]):
            b = min(a + 10, bounds[row + 1])
            if inside[a] and inside[a:b].sum() >= 6:
                assert any(x <= a and b <= y for x, y in found)
    assert all(not x < e < y for x, y in found for e in bounds)


PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(6)
    vocabulary = {"en": ["the", "and", "which", "through", "with", "weather"], "fr": ["les", "dans", "être", "où", "vous", "château"], "de": ["und", "nicht", "über", "schön", "zwischen", "wird"]}
    say = lambda l, n: " ".join(rng.choice(vocabulary[l]) for _ in range(n))
    docs = [(i, say(l, 80), l) for i, l in enumerate(["en", "fr", "de"] * 30)]
    page = lambda i, l, declared, host, n=40: (i, f"https://{host}/x", f'<html lang="{declared}"><head><title>t</title></head><body><script>var the="and";</script><p>{say(l, n)}</p></body></html>')
    rows = [page(i, "fr", "fr", "www.site.example.fr") for i in range(30)] + [page(100 + i, "en", "en", "example.com") for i in range(30)] + [page(200 + i, "de", "de", "beispiel.de") for i in range(10)]
    rows += [page(300, "de", "en", "example.com"), (301, "https://www.site.example.fr/kurz", '<html lang="fr"><body>1234</body></html>'), (302, None, None), (303, "nonsense", ""), (303, "nonsense", ""), (None, "https://example.com", "<p>the weather and the weather</p>")]
    return docs, rows


def test_language(spark):
    docs, rows = pages()
    df = clashing(spark.createDataFrame(rows, PAGES))
    got = language.identify(df, spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and all(0 < r["confidence"] <= 1 for r in got)
    said = {r["page_id"]: r["language"] for r in got}
    assert all(said[i] == "fr" for i in range(30)) and all(said[100 + i] == "en" for i in range(30)) and all(said[200 + i] == "de" for i in range(10))
    assert said[300] == "de"  # the text outweighs a wrong declaration
    assert said[301] == "fr"  # without text, declaration, suffix and host decide
    assert {r["text_language"] for r in got if r["page_id"] in (301, 302, 303)} == {None}


def test_language_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(spark.createDataFrame([], PAGES), docs).collect() == []
    rows = [(1, "http://a.fr", '<html lang="fr"><body>x</body>'), (2, None, None)]
    assert {r["language"] for r in language.identify(spark.createDataFrame(rows, PAGES), docs).collect()} == {"fr"}


def test_visible_text():
    assert language.visible("<!-- x --><head><title>t</title></head><p>a&amp;b<b>c</b></p><script>d</script>").split() == ["a", "b", "c"]
    assert language.visible(None) == ""


def test_visible_text_against_one_pattern():
    import re

    hidden = re.compile(r"<!--.*?-->|<(script|style|nav|head)\b.*?</\1\s*>", re.S | re.I)
    rng = random.Random(12)
    parts = ["<!--", "-->", "<script", "</script >", "<style>", "</style>", "<nav a", "</NAV>", "<head>", "</head\n>", "<header>", ">", "<", "a", "&amp;", "<p>", " ", "\n"]
    for _ in range(3000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert language.visible(html) == language._ENTITY.sub(" ", language._TAG.sub(" ", hidden.sub(" ", html)))


@pytest.mark.parametrize("part", ["<script", "<!--", "<", "<head><nav ", "&a", "</script  ", "<html "])
def test_long_unclosed_html(part):
    import time

    began = time.process_time()
    language.visible(part * 200_000)
    assert time.process_time() - began < 5


def test_text_model_takes_the_smallest_hashes(spark):
    docs, _ = pages()
    df = spark.createDataFrame([*docs, (7, "", "en"), (None, "x", "en"), (8, "y", None)], "doc_id long, text string, lang string")
    ranked = {r["doc_id"]: r["h"] for r in df.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    for sample in (1, 7, 100):
        want = sorted((l, t) for l in ("en", "fr", "de") for _, t in sorted((ranked[i], t) for i, t, own in docs if own == l)[:sample])
        assert sorted(map(tuple, language.sampled(df, sample).collect())) == want
    assert language.fit_text(df, 5).languages == ["de", "en", "fr"]


def test_posterior_against_brute_force(spark):
    """The fused posterior with dictionaries: text, declaration, suffix and host prior, each page's own verdict left out."""
    import collections
    import math

    docs, rows = pages()
    rows = rows + [(400, "http://news.a.co.uk/x", "<html lang=en><p>the and which</p>"), (401, "http://shop.a.co.uk/", "<p>und nicht</p>"), (402, "http://b.co.uk", "<p>les dans</p>")]
    model = language.fit_text(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, PAGES), spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    read = []
    for page, url, html in rows:
        codes = language.gram_codes([language.visible(html)])[0]
        score = [sum(model.table[k][codes]) / len(codes) * min(len(codes), language.TEXT_WEIGHT) if len(codes) else 0.0 for k in range(3)]
        verdict = score.index(max(score)) if len(codes) else None
        host = url.split("//")[1].split("/")[0] if url and "//" in url else ""
        labels = host.split(".")
        domain = ".".join(labels[-3:] if labels[-2:] == ["co", "uk"] and len(labels) > 2 else labels[-2:]) if len(labels) > 1 else ""
        declared = html.split("lang=")[1].lstrip('"')[:2] if html and "lang=" in html else ""
        read.append((page, score, verdict, declared, host, domain, labels[-1] if len(labels) > 1 else ""))
    table = collections.Counter()
    for _, _, v, *keys in read:
        for kind, key in enumerate([*keys, None]):
            table[kind, key, v] += 1
    kinds = [len({r[3] for r in read}), len({r[6] for r in read})]
    for page, score, verdict, declared, host, domain, suffix in read:
        logs = []
        for k in range(3):
            own, mine = verdict == k, verdict is not None
            whole = table[4, None, k] - own
            seen = lambda kind, key: sum(table[kind, key, j] for j in range(3)) - mine
            prior = (whole + 1) / (seen(4, None) + 3)
            prior = (table[2, domain, k] - own + 20 * prior) / (seen(2, domain) + 20)
            prior = (table[1, host, k] - own + 10 * prior) / (seen(1, host) + 10)
            told = (table[0, declared, k] - own + 5 / kinds[0]) / (whole + 5)
            ending = (table[3, suffix, k] - own + 5 / kinds[1]) / (whole + 5)
            logs.append(score[k] + math.log(told) + math.log(ending) + math.log(prior))
        best = max(logs)
        assert got[page]["language"] == model.languages[logs.index(best)] or page in (302, 303)
        assert abs(got[page]["confidence"] - 1 / sum(math.exp(x - best) for x in logs)) < 1e-6
