import random
import re

import pytest
from oracle import SMALL

from shelfspark.llm import license_scan as L
from shelfspark.llm.license_rules import IDENTIFIERS, RULES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def labels(text):
    return L.scan(text.encode())[5]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
        ("// SPDX-License-Identifier: MIT", "mit"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\")", "apache-2.0"),
        ("the GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),  # the base phrase stands in it
        ("under the GNU Affero General Public License v3", "agpl-3.0,gpl"),
        ("GNU GPL v2", "gpl-2.0"),
        ("released under the MIT license.", "mit"),
        ("mit der Lizenz", ""),
        ("by the authors of this open page", ""),
        ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        ("CC BY 4.0 and CC-BY-SA", "cc-by,cc-by-4.0,cc-by-sa"),
        ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
        ("Tous droits réservés", "reserved"),
        ("Copyright (c) 2021 Someone. All rights reserved.", "copyright,reserved"),
        ("a new BSD license", "bsd-3-clause"),
    ],
)
def test_labels(text, expected):
    assert labels(text) == expected


def test_every_identifier_is_found_and_no_other():
    for name in IDENTIFIERS.split():
        base = {"cc-by"} if name.startswith("cc-by-") else set()
        assert set(labels(f"x SPDX-License-Identifier: {name.upper()} y").split(",")) == {name} | base


def test_keywords_gate_what_patterns_need():
    """A pattern can only match where its keyword is a word, so the prefilter loses nothing."""
    assert len(RULES) > 300
    rng = random.Random(3)
    for r in RULES:
        if r.priority == 0:
            continue
        sample = r.pattern.pattern.decode("latin-1")[6:-5]
        sample = re.sub(r"\(\?:version \|version v \?\|v \?\)\?", "version ", sample).replace(r"\d", "1").replace(r"\S+", "word")
        for _ in range(20):
            s = sample
            while True:
                m = re.search(r"\((?:\?:)?([^()]*)\)(\?|\*|\{\d+,\d+\})?", s)
                if not m:
                    break
                s = s[: m.start()] + ("" if m[2] and m[2] != "{1,12}" and rng.random() < 0.5 else rng.choice(m[1].split("|"))) + s[m.end() :]
            s = re.sub(r"(\w| )\?", lambda m: rng.choice([m[1], ""]), s)
            s = re.sub(r"\[(\w)\w*\]", r"\1", s)
            line = b" " + s.encode("latin-1") + b" "
            if r.pattern.search(line):
                assert r.keyword in line.split(), (r.label, s)
                break
        else:
            raise AssertionError(f"no sample of {r.pattern.pattern} matches: {s}")


def naive(found):
    """Suppression by comparing all pairs."""

    def better(x, y):
        if not (x[0] <= y[0] and y[1] <= x[1]) or x[2].priority > y[2].priority:
            return False
        return x[2].priority < y[2].priority or (y[1] - y[0], x[2].no) < (x[1] - x[0], y[2].no)

    def order(d):
        return d[2].priority, d[0] - d[1], d[2].no

    kept = []
    for d in sorted(found, key=order):
        if not any(better(k, d) for k in kept):
            kept.append(d)
    return {(d[0], d[1], d[2].no) for d in kept}


def test_suppression(rng):
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 12)
            found.append((a, a + rng.randint(1, 8), rng.choice(RULES[100:])))
        found = list({(a, b, r.no): (a, b, r) for a, b, r in found}.values())
        assert {(a, b, r.no) for a, b, r in L.resolved(found)} == naive(found)


def test_base_against_brute_force(spark, rng):
    words = ["cc", "by", "General", "PUBLIC", "license", "all", "rights", "reserved", "é", "Émile", "x1", "©", "cc by cc by"]
    texts = [None, "", " .\n", "cc by cc by cc by", "CC\x00BY", "all-rights_reserved", "cc by", "İ cc by"]
    texts += ["".join(rng.choice(words) + rng.choice(" -_/.\n") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["cc by " * 100_000]
    df = spark.createDataFrame([(i, t, "l", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score double")
    rows = L.scan_licenses(df).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
        assert (r.score > 0) == bool(r.labels)
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_query(spark):
    from shelfspark.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op13_license_rules(spark, SMALL).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {i: brute(t) for i, t in docs.items()}
