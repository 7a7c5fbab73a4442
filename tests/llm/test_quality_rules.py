import re
from collections import Counter

from oracle import SMALL

from shelfspark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, rng):
    texts = [None, "", " \n\t ", "a", "a b a b a b", "one\ntwo\n\n one\none\n \n", "x\u00a0y z # $ <é>", "a b c d a b c", "q " * 3000, "\x0b\x0cw\r\n"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, kept string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.measure(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", f"h{i % 5}") for i in range(200)]
    rows += [(1000 + i, "short" if i < 19 else good, "bad") for i in range(20)] + [(2000, good, None), (2001, "short", "tiny"), (2002, None, None)]
    out = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1019].host_failed and not out[1019].kept and not out[1019].base_failed
    assert out[1].kept and out[2000].kept and not out[2002].kept
    f, n = [0] * 5, [40] * 5
    rates = [sum(1 for i in range(200) if i % 5 == h and not i % 10) / 40 for h in range(5)] + [0.95, 1.0]
    m = sum(rates) / 7
    v = sum((r - m) ** 2 for r in rates) / 7
    s = max(0, m * (1 - m) / v - 1)
    assert out[2001].host_failed == ((1 + m * s) / (1 + s) > 0.5)
    assert f and n


def test_no_rows(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_against_sql(spark):
    import oracle

    from shelfspark.llm import queries

    con = oracle.connect(SMALL)
    for name, sql in queries.oracle_sql().items():
        assert oracle.difference(queries.queries()[name](spark, SMALL), con, sql) == "", name


def test_shrinkage_decides(spark):
    """Hosts of one or two documents whose raw rate is over the limit are kept by the prior; a large one is not."""
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    size = {f"large{i}": (200, 20 + i) for i in range(30)} | {"one": (1, 1), "two": (2, 2), "three": (3, 2), "failing": (200, 150)}
    rows, d = [], 0
    for h, (n, f) in size.items():
        for i in range(n):
            rows.append((d := d + 1, bad if i < f else good, h))
    out = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).join(spark.createDataFrame(rows, "doc_id long, t string, source string"), "doc_id").collect()
    rate = {h: f / n for h, (n, f) in size.items()}
    m = sum(rate.values()) / len(rate)
    v = sum((r - m) ** 2 for r in rate.values()) / len(rate)
    s = max(0.0, m * (1 - m) / v - 1)
    want = {h: (f + m * s) / (n + s) > 0.5 for h, (n, f) in size.items()}
    assert {(r.source, r.host_failed) for r in out} == set(want.items())
    assert [h for h in want if want[h] != (rate[h] > 0.5)]  # where the raw rate says otherwise
    assert want["failing"] and not want["one"]
    assert all(r.kept == (r.t == good and not want[r.source]) for r in out)
