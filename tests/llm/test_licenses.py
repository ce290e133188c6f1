"""License scans against a plain version: every rule run on every text, every pair of detections compared."""

import random
import re

from vigilspark.llm import licenses

SAMPLES = [
    None, "", " ", "Released under the MIT License.", "MIT\n * License mit-license", "Licensed under the Apache License, Version 2.0.", "the GNU General  Public\tLicense, version 3.", "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: Apache-2.0 OR MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "you can redistribute it", "GPLv3", "gpl 2", "LGPL version 2.1 or later", "xMIT License",
    "MIT Licenses", "ÄMIT License", "all rights reserved. Proprietary and confidential", "https://www.apache.org/licenses/LICENSE-2.0", "http://creativecommons.org/licenses/by-sa/4.0/", "Creative Commons Attribution-ShareAlike 3.0 Unported",
    "Redistributions of source code must retain the above copyright notice, this list of conditions", "the Mozilla Public License, v. 2.0", "The Unlicense", "BSD 3-Clause License", "MİT License Klicense", "Apache License\x1cApache\x00License",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the FSF, either version 3 of the License, or (at your option) any later version.",
    "😀 MIT License 😀MIT License", "mit license general public license apache license", "may not be reproduced: no part of this book may be reproduced", "eclipse.org/legal/epl-2.0 xapache.org/licenses/license-2.0 cc0 1.0", "noncommercial use only: for non-commercial use only",
]
WORD = "[0-9a-z\x80-\U0010ffff]"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def pattern(java):
    return re.compile(java.replace("\\x{10FFFF}", "\\U0010FFFF").replace("++", "+"))


RULES = [(n, r, pattern(r.pattern)) for n, r in enumerate([*licenses.base_rules(), *licenses.rules()])]


def plain(text):
    t = lower(text or "")
    words = [(m.start(), m[0]) for m in re.finditer(WORD + "+", t)]
    base = []
    for phrase, label in licenses.BASE.items():
        w = phrase.split()
        base += [(i, label) for i in range(len(words)) if [x for _, x in words[i : i + len(w)]] == w]
    found = [(m.start(), m.end(), r.tier, n, r) for n, r, p in RULES for m in p.finditer(t)]

    def hidden(d):
        for e in found:
            if e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2]:
                if e[2] < d[2] or (e[1] - e[0]) > (d[1] - d[0]) or e[3] < d[3]:
                    return True
        return False

    kept = [d for d in found if not hidden(d)]
    best = {}
    for d in kept:
        best[d[4].label] = max(best.get(d[4].label, 0), d[4].weight)
    left = 1.0
    for label in sorted(best):
        left *= 1 - best[label]
    at = [i for i, _ in base]
    labels = {x for _, x in base}
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(best))), round(1 - left, 6))


def rows(spark, texts):
    df = spark.createDataFrame([(k, t, "x", -1) for k, t in enumerate(texts)], "doc_id long, text string, labels string, _text int")
    return {r["doc_id"]: r for r in licenses.detect(df).collect()}


def test_samples_and_mixtures(spark):
    rnd = random.Random(3)
    texts = SAMPLES + [" ".join(rnd.choice(SAMPLES[1:]) if rnd.random() < 0.7 else "lorem ipsum" for _ in range(rnd.randint(2, 7))) for _ in range(150)]
    got = rows(spark, texts)
    for k, t in enumerate(texts):
        r = got[k]
        want = plain(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == want[:-1], t
        assert abs(r["score"] - want[-1]) < 2e-6
        assert r["_text"] == -1


def test_long_text_and_empty_table(spark):
    text = "word " * 50000 + "MIT License " * 3000 + "tail " * 1000
    r = rows(spark, [text, text])
    assert [(r[k]["n_words"], r[k]["n_base"], r[k]["first_word"], r[k]["last_word"], r[k]["labels"]) for k in (0, 1)] == [(57000, 3000, 50000, 55998, "mit")] * 2
    assert rows(spark, []) == {}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.report(empty).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and licenses.report(empty).count() == 0


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 300 and all(r.gate for _, r, _ in RULES)
