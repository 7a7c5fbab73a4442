import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import language_id as L
from shelfspark.llm.queries import fold


def naive(a, e, lens):
    """Posteriors by one pass forward and one back."""
    out, expected, at = [], np.zeros_like(a), 0
    for n in lens:
        x = e[at : at + n]
        at += n
        k = a.shape[0]
        f, b = np.zeros((n, k)), np.ones((n, k))
        for t in range(n):
            f[t] = ((f[t - 1] if t else np.full(k, 1 / k)) @ a) * x[t]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = a @ (x[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        g = f * b
        out.append(g / g.sum(axis=1, keepdims=True))
        for t in range(1, n):
            j = f[t - 1][:, None] * a * (x[t] * b[t])[None]
            expected += j / j.sum()
    return np.concatenate(out), expected


def test_segments_give_the_whole_pass():
    g = np.random.default_rng(3)
    for lens in ([1], [5, 64, 65, 200, 1], [700], [63, 128, 129]):
        t = g.normal(size=(4, 4))
        e = g.uniform(0.01, 1, (sum(lens), 4))
        got, pairs = L.Chain(np.array(lens), t).run(e, pairs=True)
        want, expected = naive(np.exp(t - t.max()), e, lens)
        assert np.allclose(got, want) and np.allclose(pairs, expected)


def test_features_of_odd_words():
    where, counts = L.features(["a", "###", "éé", "12", "x1", "a" * 500])
    assert counts[1] == counts[3] == 0 and counts[0] > 0 and counts[5] > 1000
    assert len(where) == counts.sum()
    again, n = L.features(["éé"])
    assert again.tolist() == where[counts[:2].sum() : counts[:3].sum()].tolist() and n[0] == counts[2]


def test_held_out_accuracy_and_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs, fold(4) != 2, per_language=60)
    found = L.identify(docs.select("doc_id", "text", "lang"), model).where(fold(4) == 2)
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count()
    by = {r.lang: r.text for r in docs.where("n_chars > 1500").orderBy("doc_id").limit(60).collect()}
    a, b = "\n".join(by["de"].split("\n")[:6]), "\n".join(by["es"].split("\n")[:6])
    words = L.words_of(a) + L.words_of(b)
    index = list(dict.fromkeys(words))
    where, counts = L.features(index)
    e = L.emissions(L.sum_by_word(model["w"][where], counts))[[index.index(w) for w in words]]
    post, _ = L.Chain(np.array([len(words)]), model["t"]).run(e)
    labels = np.array(model["langs"])[post.argmax(axis=1)]
    n = len(L.words_of(a))
    assert (labels[:n] == "de").mean() > 0.9 and (labels[n:] == "es").mean() > 0.9


def test_odd_rows(spark):
    rows = [(1, "das ist ein haus und der garten", "de", 0.5), (2, "the house and the garden is here", "en", None), (3, None, "en", None), (4, "", None, None), (5, "12 ### \n", "en", None), (None, "the garden", None, None), (2, "the house and the garden is here", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, other double")
    model = L.train(df, F.lit(True), rounds=20)
    got = L.identify(df, model).collect()
    assert len(got) == 7 and model["langs"] == ["de", "en"]
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (3, 4, 5))
    assert by[1].lang_pred == "de" and by[2].lang_pred == by[None].lang_pred == "en" and 0 <= by[2].score <= 1
    empty = L.train(df, F.lit(False))
    assert {r.lang_pred for r in L.identify(df, empty).collect()} == {"und"}
    assert L.identify(df.where("false"), model).count() == 0


def test_no_size_of_a_language_drops_it(spark):
    """Counts a million times as large as the table: the cut by share alone would leave none or few."""
    assert L.share(120, 10**12) > 0 and L.share(120, 50) == L.HASH_STEPS
    rows = [(i, f"text {i}", "de" if i % 2 else "en") for i in range(4000)] + [(9, "text 9", "de")] * 3000 + [(9000, "rare", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.sampled(df, F.lit(True), per_language=50).collect()
    n = {k: sum(r.lang == k for r in got) for k in ("de", "en", "fr")}
    assert n == {"de": 50, "en": 50, "fr": 1} and len({r.text for r in got}) == len(got)
    for size in (10**8, 10**10):  # the share that each size keeps is what it should be
        assert 250 < L.share(120, size) / L.HASH_STEPS * size < 270


def test_columns_of_the_user(spark):
    rows = [(1, "the garden and the house", "en", 0.5, "mine"), (2, "der garten und das haus", "de", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, `a``b.c` string").withColumn("langs", F.lit(1))
    model = L.train(df, F.lit(True), rounds=20)
    got = L.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "a`b.c", "langs", "lang_pred", "score"]
    assert {r.doc_id: (r.lang_pred, r["a`b.c"]) for r in got.collect()} == {1: ("en", "mine"), 2: ("de", None)}
    got = L.identify(df, model, ("found", "sure")).collect()
    assert {r.doc_id: (r.found, r.score) for r in got} == {1: ("en", 0.5), 2: ("de", None)}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "the garden and the house " * 60_000, "en"), (2, "der garten und das haus", "de"), (3, "the house", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df, L.train(df.where("doc_id > 1"), F.lit(True), rounds=20)).collect()}
    assert got[1][0] == "en" and got[1][1] > 0.5
