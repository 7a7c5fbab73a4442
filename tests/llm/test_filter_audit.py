import re
from collections import Counter
from itertools import permutations

import pytest

from shelfspark.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS, LABELS = "doc_id long, text string, lang string, part string, n int, fp string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = {}
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        w = WORD.findall(t)
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and least[t] < i)
        rows.append((i, lang or "", f))
    for part in {r[1] for r in rows}:
        total = Counter()
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[1] == part]
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[2]]
                own = [r for r in rows if r[1] == part and f in r[2]]
                left = [r for r in left if f not in r[2]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(own) - len(gone), sum(r[2] == f for r in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def compare(spark, docs, labels, partitions=3):
    df = spark.createDataFrame(docs, DOCS).repartition(partitions)
    got = A.audit(df, spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == brute(docs, labels)
    assert len(got) == 600 * len({r.part for r in got})


@pytest.fixture
def many_ranges(spark):
    """So many partitions that a group of copies spans several of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def texts(rng):
    few = ["", None, "a b", "A B C", "w#", " ".join(f"w{i}" for i in range(120)), "Q " * 150, "é" * 50, "x y " * 99 + "z z"]
    return few + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(90, 130))) for _ in range(10)]


def test_against_brute_force(spark, rng):
    t = texts(rng)
    docs = [(rng.randint(0, 150) if rng.random() > 0.05 else None, rng.choice(t), rng.choice(["en", "de", "", None]), "p", 1, "f") for _ in range(300)]
    docs += docs[:20]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(100)] + [(i, 1, 0) for i in range(0, 100, 7)] + [(None, 1, 1)]
    compare(spark, docs, labels)


def test_large_group_over_many_tasks(spark, rng, many_ranges):
    docs = [(i, "the same text" if i % 3 else f"own {i}", rng.choice(["en", None]), None, None, None) for i in range(600)]
    rng.shuffle(docs)
    compare(spark, docs + docs[:50], [(i, i % 2, int(i % 5 == 0)) for i in range(600)], 7)


def test_same_fingerprint_is_not_the_same_text(spark, monkeypatch, many_ranges):
    monkeypatch.setattr(A.F, "xxhash64", lambda c: A.F.lit(5).cast("long"))
    docs = [(i, f"text {i % 4}", "en", None, None, None) for i in range(120)]
    compare(spark, docs, [])


def test_no_rows_and_very_long_text(spark):
    assert A.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    compare(spark, [(2, "Word é " * 300_000, "en", None, None, None), (1, "Word é " * 300_000, "en", None, None, None)], [(2, 1, 1)])
