from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tests_llm_tools import parts, sentence

from shelfspark.llm import line_dedup as L

WHITE = " \t\n\x0b\x0c\r"


def grams(x):
    return {x[i : i + 8] for i in range(len(x) - 7)} or {x}


def brute(docs):
    """Numbers of the lines to remove, by document."""
    rows = sorted({(d is not None, d or 0, t) for d, t in docs if t is not None})
    lines = [(r, n, x) for r in rows for n, x in enumerate(r[2].split("\n")) if x.strip(WHITE)]
    texts = sorted({x for _, _, x in lines})
    sets = [grams(x) for x in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = parts(links, range(len(texts)))
    seen, gone = set(), defaultdict(list)
    for r, n, x in lines:
        k = root[texts.index(x)]
        if k in seen:
            gone[r].append(n)
        seen.add(k)
    return gone


def corpus(rng):
    pool = [sentence(rng, rng.randint(4, 40)) for _ in range(30)] + ["short", "ab", "}", "é" * 20]
    near = [p[: len(p) // 2] + "q" + p[len(p) // 2 + 1 :] for p in pool] + [p + "!" for p in pool]
    docs = [(i, "\n".join(rng.choice(pool + near + [sentence(rng, 12), "", "  "]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "\n\n"), (None, pool[0] + "\nx y"), (5, docs[5][1]), (103, pool[1] + "\n" + "\n".join(f"n{i}" for i in range(300)))]


def test_report_and_texts_equal_brute_force(spark, rng):
    docs = corpus(rng)
    gone = brute(docs)
    df = spark.createDataFrame([(d, t, [1], "y") for d, t in docs], "doc_id long, text string, removed array<int>, line string")
    got = L.line_report(df.select("doc_id", "text")).collect()
    at = lambda d, t: gone.get((d is not None, d or 0, t), [])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(d, len(t.split("\n")) if t is not None else 0, len(at(d, t)), at(d, t)) for d, t in docs]
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, list(r.removed)) for r in got), key=key) == sorted(want, key=key)

    out = L.dedup_lines(df)
    assert out.columns == df.columns
    keep = lambda d, t: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in at(d, t))
    key2 = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key2) == sorted(((d, keep(d, t)) for d, t in docs), key=key2)
    left = L.dedup_lines(df, drop_emptied=True).count()
    full = lambda t: [n for n, x in enumerate((t or "").split("\n")) if x.strip(WHITE)]
    assert left == sum(not at(d, t) or len(at(d, t)) < len(full(t)) for d, t in docs)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_report(df).count() == 0 and L.dedup_lines(df).count() == 0


def test_banding_recalls_links(rng):
    hit = total = 0
    for n in (12, 25, 60, 200):
        for _ in range(150):
            a = sentence(rng, n)
            b = list(a)
            for _ in range(rng.randint(1, max(1, len(a) // 90))):
                b[rng.randrange(len(b))] = "#"
            b = "".join(b)
            if len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)):
                total += 1
                x = L.line_bands([a, b])
                hit += bool((x[0] == x[1]).any())
    assert total > 100 and hit / total >= 0.99


def test_signatures_estimate_similarity(rng):
    a = sentence(rng, 400)
    b = a[:1200] + sentence(rng, 150)
    s = L.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - len(grams(a) & grams(b)) / len(grams(a) | grams(b))) < 0.08
    assert (L.signatures(["}", "}", ""], 48)[0] == L.signatures(["}"], 48)[0]).all() and np.isfinite(s.astype(float)).all()


def test_columns_of_the_user_stay(spark):
    line = "a line that is long enough to be a duplicate of another"
    rows = [(1, line + "\nfirst", [7], 5, "x"), (2, "second\n" + line, [8], None, None), (2, "second\n" + line, [8], None, None), (3, None, None, 6, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed array<int>, row int, `a``b.c` string").withColumn("id", F.lit("i"))
    got = L.dedup_lines(df)
    assert got.columns == df.columns
    want = [(1, line + "\nfirst", [7], 5, "x", "i"), (2, "second", [8], None, None, "i"), (2, "second", [8], None, None, "i"), (3, None, None, 6, "z", "i")]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want


def test_very_long_text(spark):
    text = "\n".join(f"line number {i} of a very long text, with words of its own {i * 7919}" for i in range(4_000))
    got = L.line_report(spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_lines for r in got} == {1: 4_000, 2: text[: len(text) // 2].count("\n") + 1}
    assert {r.doc_id: r.n_removed for r in got}[2] >= 1_950
