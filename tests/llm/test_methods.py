"""What the operators' methods do inside the queries, and scores against sequential versions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tonearm.llm import common, decontaminate, dedup_exact, html_text, licenses, substrings, toxicity

from . import brute


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sequential_quoted(text, a, b):
    """Whether a pair of quotation marks stands round the place, mark by mark."""
    opened, spans = {}, []
    for at, c in enumerate(text):
        if c == "\n":
            opened.pop('"', None)
        elif c == '"':
            if c in opened:
                spans.append((opened.pop(c), at))
            else:
                opened[c] = at
        elif c in toxicity.PAIRS and toxicity.PAIRS[c] in opened:
            spans.append((opened.pop(toxicity.PAIRS[c]), at))
        elif c in toxicity.PAIRS.values():
            opened[c] = at
    return any(s < a and b <= e for s, e in spans)


def sequential_score(model, text):
    text = text.lower()
    own, n = [], 0
    for m in toxicity._WORD.finditer(text):
        n += 1
        best = None
        for k, term in enumerate(model.terms):
            stem, word = term.rstrip("$"), m[0]
            most = toxicity.allowed_edits(term)
            ways = [edits(stem, word)] if term.endswith("$") else [edits(stem, word[:j]) for j in range(len(word) + 1)]
            if min(ways) <= most and (best is None or (min(ways), k) < best):
                best = (min(ways), k)
        if best:
            quoted = sequential_quoted(text, *m.span()) or toxicity.reported(text, *m.span())
            w = model.weights.get((best[1], best[0]), 0) * (model.discount if quoted else 1)
            if w:
                own.append(w)
    total = sum(own)
    x = [math.log1p(total), min(100 * total / max(n if own else 0, 20), 50.0), math.log1p(len(own)), max(own, default=0.0), float(len(own) > 1)]
    z = model.intercept + sum(c * v for c, v in zip(model.coefficients, x))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_quotations_of_any_depth():
    """A hit is quoted however many other quotations end between it and the mark that closes its own."""
    matcher = toxicity.Matcher(["idiot$"])
    for inner in range(8):
        text = "“ you idiot " + "«f» " * inner + "”"
        assert toxicity.hits_in(matcher, text) == [(0, 0, True)]
    assert toxicity.hits_in(matcher, "«f» idiot «g» “h”") == [(0, 0, False)]
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["idiot ", "“", "”", "«", "»", '"', "x ", "\n"]) for _ in range(14))
        assert [q for *_, q in toxicity.hits_in(matcher, text)] == [sequential_quoted(text, m.start(), m.end()) or toxicity.reported(text, *m.span()) for m in re.finditer(r"\bidiot\b", text)]


def test_scores_against_a_sequential_version(spark, docs):
    model = toxicity.Model(["idiot$", "moro"], {(0, 0): 3.0, (0, 1): 1.5, (1, 0): 2.0, (1, 1): 1.0}, [0.7, 0.1, 0.4, 0.2, 0.3], -2.5, 0.4)
    rng = random.Random(5)
    words = ["idiot", "idiots", "idjot", "moron", "moronic", "maron", "nice", "day", "said", "“", "”", '"', "you", "\n"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(120)] + [(500, None), (501, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs(rows), model).collect()}
    for k, text in rows:
        assert got[k] == pytest.approx(sequential_score(model, text or ""), abs=1e-9), text


def test_exact_dedup_by_runs(spark, docs, monkeypatch):
    """One batch fills several memtables; their runs meet each other's filters and are merged by level."""
    tested, made = [], []
    whole, build = dedup_exact.Run.tested, dedup_exact.Run.__init__
    monkeypatch.setattr(dedup_exact.Run, "tested", lambda self, e: tested.append(self) or whole(self, e))
    monkeypatch.setattr(dedup_exact.Run, "__init__", lambda self, e: made.append(self) or build(self, e))
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None, "", f"own {k}", "c" * 3000])) for k in range(300)]
    got = sorted(tuple(r) for r in dedup_exact.exact_duplicates(docs(rows).repartition(9), keep="max").collect())
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    want = [(k, max(groups[t or ""]), len(groups[t or ""]), k == max(groups[t or ""])) for k, t in rows]
    assert [g[:4] for g in got] == want
    assert len(tested) >= dedup_exact.MEMTABLES - 1 and len(made) > dedup_exact.MEMTABLES
    run = dedup_exact.Run(dedup_exact.flush(dedup_exact.fill_memtables(docs(rows).selectExpr("doc_id", "coalesce(text, '') as text"))))
    assert run.tested(run.entries).where("not maybe").count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        ('<article><p>t</p><div class="comment-list">c1</div><div class="cookie-banner">we use cookies</div></article>', "t"),
        ('<div class="site-footer">f</div><div class="main-nav">n</div><article><h1>H</h1>body<div class="post-comments">x</div></article><div class="sidebar-left">s</div>', "H body"),
        ('<article>real text</article><section class="related"><article>teaser</article></section>', "real text"),
        ('<p title="x>leak</p>', "leak"),
        ('<article class="post comments-open">a b</article>', "a b"),
        ('<div class="content-sidebar-wrap"><p>all the text of the page</p></div>', "all the text of the page"),
        ('<article><h2 id="related-work">Related work</h2><section id="related-work">text</section></article>', "Related work text"),
        ('<form class="x"><h1>T</h1><p>para</p></form><p>other</p>', "T para other"),
        ('<div class="search"><main><p>long text in main</p></main></div>', "long text in main"),
        ('<div class="siteFooter">foo</div><p>a few words of text</p><div id="newsletter_box">sign up</div>', "a few words of text"),
        ('<article><div class="share-frame"><p>the whole article stands in here</p></div></article>', "the whole article stands in here"),
    ],
)
def test_boilerplate(html, text):
    assert html_text.Page(html).text() == text


def test_pages_of_one_kind_are_linear():
    import time

    for unit, n in (("<a ", 200_000), ("<div class='x'>y", 60_000), ('<i t="', 100_000), ("</p>", 200_000)):
        began = time.monotonic()
        html_text.Page(unit * n).text()
        assert time.monotonic() - began < 20, unit


def test_substrings_in_many_buckets(spark, docs, monkeypatch):
    """Few anchors a bucket and few strings a salt give the same rows."""
    monkeypatch.setattr(substrings, "BUCKET_ANCHORS", 3)
    monkeypatch.setattr(substrings, "SALT_STRINGS", 50)
    monkeypatch.setattr(substrings, "HOT_ANCHORS", 6)
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefg hij", k=700))
    rows = [(k, "".join(rng.choices("klmnop qr", k=300)) + (passage[rng.randint(0, 200) :] if k % 2 else "") + str(k)) for k in range(24)] + [(30, None), (31, "short")]
    got = sorted(tuple(r)[:5] for r in substrings.removed(substrings.repeated_spans(docs(rows))).collect())
    assert got == sorted(brute.removed(rows))


#: Whole license texts as they stand in files, and the labels that they must get.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."""
BSD = """ * Redistribution and use in source and binary forms, with or
 * without modification, are permitted provided that the
 * following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with
# the License. You may obtain a copy of the License at"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or"""


def all_windows(text):
    """Labels and score by every window of words and every line."""
    ws = common.words(text)
    found = {}
    for label, template, key in [*((label, t, "") for label, t in licenses.TEMPLATES), *licenses.GRANTS]:
        words = common.words(template)
        tokens, width, keys = set(words), math.ceil(len(words) / licenses.THRESHOLD), set(common.words(key))
        need = max(1, math.ceil(licenses.THRESHOLD * len(tokens)))
        blocks = [set(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))] + ([] if key else [set(common.words(line)) for line in text.split("\n")])
        best = max((len(b & tokens) for b in blocks if keys <= b), default=0)
        if best >= need:
            found[label] = max(found.get(label, 0), best / len(tokens))
    base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} ".encode() in b" " + b" ".join(ws) + b" "}
    return ",".join(sorted(base | found.keys())), 1.0 if base else max(found.values(), default=0.0)


def test_license_scores_against_all_windows(docs):
    rng = random.Random(9)
    parts = [t.split() for _, t in licenses.TEMPLATES] + [t.split() for _, t, _ in licenses.GRANTS]
    texts = [MIT, BSD, APACHE, GPL, "x " * 50 + MIT.replace(" ", "\n") + " y" * 50, "", "no licence"]
    for _ in range(120):
        words = [w for p in rng.sample(parts, 2) for w in p if rng.random() < 0.9]
        for _ in range(rng.randint(0, 6)):
            words.insert(rng.randint(0, len(words)), rng.choice(["foo", "bar", "\n"]))
        texts.append(" ".join(words))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs(list(enumerate(texts)))).collect()}
    assert [label for k in range(5) for label in got[k][0].split(",")] == ["mit", "bsd", "apache", "gpl", "mit"]
    for k, text in enumerate(texts):
        assert got[k] == (all_windows(text)[0], pytest.approx(all_windows(text)[1])), text
    assert any(0 < s < 1 for _, s in got.values())


def test_decontamination_in_salts_and_filters(spark, docs, monkeypatch):
    """Many salts, hits of many tasks and a filter in place of the list find the same, with the longest matches' places."""
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "x"]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(9)] + [(20, None), (21, "..."), (22, "beta"), (22, "beta")]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40))) + (" " + items[k % 9][1] if k % 2 else "")) for k in range(30)] + [(40, None), (41, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("code", F.lit(1))
    want = sorted(brute.contaminated(rows, [*items[:-1]]), key=repr)
    for salt, hits, most in ((200_000, 500_000, 1_000_000), (7, 11, 1_000_000), (50, 90, 0)):
        monkeypatch.setattr(decontaminate, "SALT_SUFFIXES", salt)
        monkeypatch.setattr(decontaminate, "TASK_HITS", hits)
        found = decontaminate.find_matches(docs(rows).repartition(4).withColumns({"doc": F.lit(3), "bucket": F.lit(1), "key": F.lit(b"")}), bench, block_words=most)
        judged = decontaminate.contamination(found)
        got = judged.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ","), 256), "contaminated")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
        texts = dict(rows)
        for r in found.collect():
            ws = common.words(texts[r["doc_id"]] or "")
            for m in r["matches"] or ():
                item = common.words(dict(items)[m["item_id"]])
                assert ws[m["word"] : m["word"] + m["n_words"]] == item[m["item_word"] : m["item_word"] + m["n_words"]]
                if len(item) >= 13:  # as long as it can be
                    a, b = m["word"] + m["n_words"], m["item_word"] + m["n_words"]
                    assert a == len(ws) or b == len(item) or ws[a] != item[b]


def test_filters_take_one_python_step(spark, docs, monkeypatch):
    """A step before the filter's own in the same task is a second Python worker, and each keeps its memory."""
    from tonearm.llm import jaccard_join

    kind = type(spark.range(1))
    real, seen = kind.mapInArrow, []

    def alone(self, *args, **kwargs):
        assert "MapInArrow" not in self._jdf.queryExecution().analyzed().toString()
        seen.append(1)
        return real(self, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", alone)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(k, f"{text} {k}") for k in range(4)]
    bench = spark.createDataFrame([("x", text)], "item_id string, text string")
    assert {r["component_id"] for r in jaccard_join.near_duplicates(docs(rows)).collect()} == {0}
    assert all(r["matches"] for r in decontaminate.find_matches(docs(rows), bench, block_words=0).collect())
    assert substrings.removed(substrings.repeated_spans(docs([(k, "long text " * 99) for k in range(2)]))).where("n_removed > 0").count() == 2
    assert len(seen) > 8
