import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from shelfspark.llm import lm_scoring as L
from shelfspark.llm.queries import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def toks(text):
    return [w.translate(UPPER) for w in WORD.findall(text or "")] + ["\n"]


class Automaton:
    """States, arcs and failure arcs in dictionaries; one token at a time."""

    def __init__(self, texts, order, mu):
        c = [None] + [Counter() for _ in range(order)]
        for t in texts:
            w = toks(t)
            for k in range(1, order + 1):
                c[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        self.order, self.n, self.v, self.c1 = order, sum(c[1].values()), len(c[1]), c[1]
        prob = {}
        self.arcs, self.fail = defaultdict(dict), {}
        for k in range(1, order + 1):
            for g, n in c[k].items():
                if k == 1:
                    prob[g] = self.uni(g[0])
                else:
                    h = c[k - 1][g[:-1]]
                    m = mu[k][0] * h ** mu[k][1]
                    prob[g] = (n + m * prob[g[1:]]) / (h + m)
                self.arcs[g[:-1]][g[-1]] = math.log10(prob[g])
                if k < order:
                    m = mu[k + 1][0] * n ** mu[k + 1][1]
                    self.fail[g] = math.log10(m / (n + m))

    def uni(self, w):
        return (self.c1[(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def score(self, text):
        state, total = (), 0.0
        for w in toks(text):
            s = state
            while s and w not in self.arcs[s]:
                total += self.fail[s]
                s = s[1:]
            total += self.arcs[s].get(w, math.log10(self.uni(w))) if s == () else self.arcs[s][w]
            state = (state + (w,))[-(self.order - 1) :] if self.order > 1 else ()
            while state and state not in self.fail:
                state = state[1:]
        return total


@pytest.mark.parametrize("chunk_bytes,wide", [(1 << 20, 12), (3000, 12), (3000, 1)])
def test_equals_the_automaton(spark, chunk_bytes, wide, monkeypatch):
    """One chunk; many chunks and buckets; and with relays between them."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    docs += [(1001, None), (1002, ""), (1003, "A b\tB a\x0bé É"), (None, "the of"), (1003, "A b\tB a\x0bé É"), (1004, "zz " * 5000)]
    held = {i: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for i, (d, _) in enumerate(docs)}
    model = Automaton([t for i, (_, t) in enumerate(docs) if not held[i]], 3, L.MU)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, train int")
    monkeypatch.setattr(L, "BUCKET_KEYS", 2_000_000 if chunk_bytes > 10_000 else 500)
    got = L.score_documents(df.select("doc_id", "text"), fold(5) != 1, chunk_bytes=chunk_bytes, wide=wide, relay=3).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = []
    for i, (d, t) in enumerate(docs):
        w = toks(t)
        want.append((d, held[i], len(w), sum(model.c1[(x,)] > 0 for x in w), model.n, sum(math.log10(model.uni(x)) for x in w), model.score(t)))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_held_out_text_is_more_likely_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = L.score_documents(docs, fold(5) != 1).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_nothing_to_learn_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = L.score_documents(df, F.lit(False)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0)
    assert r.score == pytest.approx(0.0)
    assert L.score_documents(df.where("false"), F.lit(True)).count() == 0
