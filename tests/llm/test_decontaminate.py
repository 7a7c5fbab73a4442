from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import decontaminate as D
from tests_llm_tools import sentence


def least_distance(pattern, text):
    """Sellers' algorithm: least edit distance to any substring."""
    col = list(range(len(pattern) + 1))
    best = (col[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(col[i - 1] + (p != c), col[i] + 1, new[i - 1] + 1))
        col = new
        best = min(best, (col[-1], j), key=lambda x: x[0])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
def test_myers_equals_dynamic_programming(pattern, text):
    assert D.myers(pattern, text)[0] == least_distance(pattern, text)[0]


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("qxz")
        elif kind == 1:
            t.insert(i, rng.choice("qxz"))
        else:
            del t[i]
    return "".join(t)


def test_hits_are_those_of_brute_force(spark, rng):
    items = [(i, sentence(rng, 30)) for i in range(6)] + [(6, None), (7, ""), (8, "tiny item"), (9, "  ")]
    docs = [(100 + i, sentence(rng, 60)) for i in range(6)]
    for i in range(40):
        text, k = items[i % 6][1], D.budget(len(D.normal(items[i % 6][1])))
        n = rng.choice([0, 1, k // 2, k, k + 1, 2 * k])
        docs.append((200 + i, sentence(rng, 20) + "\n " + edited(rng, text, n).upper() + "  " + sentence(rng, 15)))
    docs += [(300, None), (301, ""), (302, "so TINY\n  ITEM here"), (None, items[0][1]), (303, items[0][1] + " " + items[1][1]), (303, items[0][1] + " " + items[1][1])]
    want = []
    for d, t in docs:
        for i, item in items:
            if t and item and item.strip():
                p = D.normal(item)
                dist = least_distance(p, D.normal(t))[0]
                if dist <= D.budget(len(p)):
                    want.append((d, i, dist))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(df, bench).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=key) == sorted(want, key=key)
    texts = {d: D.normal(t) for d, t in docs if t}
    for r in got:
        span = texts[r.doc_id][r.span_start : r.span_end]
        assert least_distance(D.normal(dict(items)[r.item_id]), span)[0] == r.distance
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    hit = {w[0] for w in want}
    assert sorted((r.doc_id for r in kept.collect())) == sorted(d for d, _ in docs if d not in hit)


def test_blocks_and_empty_tables(spark, rng):
    items = spark.createDataFrame([(i, sentence(rng, 20)) for i in range(5)], "item_id long, text string")
    assert len(list(D._blocks(items, 100))) > 1
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.contamination(docs, none).count() == 0
    assert D.drop_contaminated(docs, none).count() == 1
    assert D.contamination(docs.where("false"), items).count() == 0
