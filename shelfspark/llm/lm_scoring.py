"""Language-model scores from a weighted backoff automaton.

Model: n-grams up to ORDER of the training documents under hierarchical
Dirichlet smoothing (MacKay and Peto, 1995).  With c the training counts,

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | h) = (c(hw) + m(h) * p(w | h')) / (c(h) + m(h)),  m(h) = scale * c(h) ** power

with h' the history h without its first token.  The prior weight m(h) follows
the history's count as the number of its continuations does (Heaps' law), so a
frequent history keeps mass for what it has not been followed by.

A backoff automaton represents this model exactly.  States are the histories seen
in training, shorter than ORDER; a state h has an arc for each w with
c(hw) > 0, weighted log10 p(w | h), and a failure arc to its longest proper
suffix, weighted log10(m(h) / (c(h) + m(h))).  The empty history has an arc for
every word.  No n-gram is pruned, so the automaton grows with the corpus and
no machine holds it: each chunk of documents looks up its part of it (see
``common``), the states and arcs that its texts can reach.  A text is scored in
one traversal from left to right that carries the state: failure arcs are
followed until the state has an arc for the word, which is taken, and the
weights of all of them add up.  The state after the end token is dropped.
Tests hold the scores against an automaton built of dictionaries.

Words are told apart by 56 bits of a hash within a bucket of about two million
(one bucket in 36,000 has two words that share their counts), longer n-grams by
40 bits, of which about two in a million share theirs with another.  N and V are summed up over the buckets of words.

Defined results.  Tokens are runs of characters other than ASCII white space,
A-Z lower-cased, then one end token.  A null text is empty: the end token
alone.  doc_id must be a whole number or its text.  A null doc_id counts as an empty string in the training rule.  Repeated
rows are trained on and scored each.  No rows: no rows.  If nothing is in the
training part, N and V are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import CHUNK_BYTES, HASHES, RELAY, WIDE_BITS, Space, answered, asked, asked_schema, bits_for, dealt, groups_for, keep_only, lookup, mix, settled, ship, sums, text_size, tidy, word_space

ORDER = 3
MU = {2: (4.0, 0.85), 3: (1.0, 0.85)}  # order: (scale, power)
BUCKET_KEYS = 2_000_000
STEP = 1 << 16  # places whose weights are unpacked at a time
END = b"\n"  # never a word
_C = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> list[bytes]:
    return (text.lower().split() if text else []) + [END]


def _ngrams(texts: list, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tokens per document, place in the document, and the n-gram hashes that end at each token."""
    words: list[bytes] = []
    lens = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = tokens(t)
        lens[i] = len(w)
        words += w
    t = HASHES.of(words)
    place = np.arange(len(t)) - np.repeat(np.cumsum(lens) - lens, lens)
    grams = [mix(t)]
    for k in range(2, order + 1):
        h = np.zeros(len(t), dtype=np.uint64)
        h[1:] = mix(grams[-1][:-1] * _C + t[1:] + np.uint64(k))
        grams.append(h)
    return lens, place, grams


def _table_texts(table: pa.Table) -> list:
    return table.column("text").cast(pa.binary()).to_pylist()


def _count_words(space: Space):
    """(tokens, types) of each bucket of words, from what was asked of it."""

    def run(table: pa.Table) -> pa.Table:
        found = [sums(table, space)[0]] if table.column("space")[0].as_py() == 0 else []
        return pa.table({"tokens": pa.array([int(c.sum()) for c in found], pa.int64()), "types": pa.array([int((c > 0).sum()) for c in found], pa.int64())})

    return run


def _ask(spaces: list[Space]):
    def run(table: pa.Table) -> pa.Table:
        keep_only("hashes")
        lens, place, grams = _ngrams(_table_texts(table), len(spaces))
        train = np.repeat(table.column("train").to_numpy(zero_copy_only=False), lens)
        found = []
        for no, space in enumerate(spaces):
            valid = place >= no
            keys = space.key(grams[no])
            uniq = np.unique(keys[valid])
            seen, n = np.unique(keys[valid & train], return_counts=True)
            counts = np.zeros(len(uniq), dtype=np.int64)
            counts[np.searchsorted(uniq, seen)] = n
            found.append((no, space, uniq, [counts]))
        out = asked(table.column("chunk")[0].as_py(), found)
        tidy()
        return out

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def weights(order: int, mu: dict, n: int, v: int, uniq_at: list, first: list, counts: list) -> tuple[list, list]:
    """log10 weights of the arcs of each n-gram, and of the failure arcs of each state.

    uniq_at[k-1]: the n-gram of order k that ends at a place, as an index;
    first[k-1]: a place where each n-gram ends; counts[k-1]: training counts.
    """
    prob = [(counts[0] + 0.5) / (n + 0.5 * (v + 1))]
    arcs, fails = [np.log10(prob[0])], []
    for k in range(2, order + 1):
        at = first[k - 1]
        scale, power = mu[k]
        history = counts[k - 2][uniq_at[k - 2][at - 1]]
        m = scale * np.maximum(history, 1) ** power
        prob.append((counts[k - 1] + m * prob[k - 2][uniq_at[k - 2][at]]) / (history + m))
        arcs.append(np.log10(prob[-1]))
        m = scale * np.maximum(counts[k - 2], 1) ** power
        fails.append(np.log10(m / (counts[k - 2] + m)))
    return arcs, fails


def traverse(place: np.ndarray, uniq_at: list, counts: list, arcs: list, fails: list) -> np.ndarray:
    """log10 probability of each document, in one pass that carries the automaton's state.

    The state is told by the length of its history, the tokens before the place.
    """
    longest = len(fails)
    seen = np.zeros(len(place), dtype=np.int8)  # the longest n-gram of the model that ends at a place
    for k, (at, c) in enumerate(zip(uniq_at, counts)):
        if len(c):  # texts of a chunk may all be shorter than an n-gram; then no state asks for its weights
            seen[(seen == k) & (place >= k) & (c[at] > 0)] = k + 1
    scores: list[float] = []
    state, total = 0, 0.0
    for lo in range(0, len(place), STEP):
        here = slice(lo, lo + STEP)
        before = np.maximum(np.arange(lo, min(lo + STEP, len(place))) - 1, 0)
        arc = [w[at[here]].tolist() if len(w) else [] for w, at in zip(arcs, uniq_at)]
        fail = [w[at[before]].tolist() if len(w) else [] for w, at in zip(fails, uniq_at)]
        for i, (begins, reach) in enumerate(zip((place[here] == 0).tolist(), seen[here].tolist())):
            if begins:
                scores.append(total)
                state, total = 0, 0.0
            while state and state >= reach:  # no arc for the word
                total += fail[state - 1][i]
                state -= 1
            total += arc[state][i]
            if reach and state < longest:
                state += 1
    scores.append(total)
    return np.array(scores[1:])


def _score(spaces: list[Space], mu: dict):
    order = len(spaces)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        lens, place, grams = _ngrams(_table_texts(docs), order)
        n, v = (answers.column(c)[0].as_py() for c in ("tokens", "types"))  # every chunk asks for the end token at least
        uniq_at, first, counts = [], [], []
        for no, space in enumerate(spaces):
            where = np.flatnonzero(place >= no)
            uniq, at, inv = np.unique(space.key(grams[no][where]), return_index=True, return_inverse=True)
            full = np.zeros(len(place), dtype=np.int64)
            full[where] = inv
            uniq_at.append(full)
            first.append(where[at])
            counts += answered(answers, no, space, uniq, 1)
            grams[no] = None
        arcs, fails = weights(order, mu, n, v, uniq_at, first, counts)
        starts = np.cumsum(lens) - lens
        known = np.add.reduceat((counts[0] > 0)[uniq_at[0]].astype(np.int64), starts)
        train = docs.column("train").combine_chunks()
        tidy()
        return pa.table(
            {
                "doc_id": docs.column("doc_id").combine_chunks(),
                "held_out": pa.array([not x for x in train.to_pylist()], pa.bool_()),
                "n_tokens": pa.array(lens, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(lens), n), pa.int64()),
                "base_score": pa.array(np.add.reduceat(arcs[0][uniq_at[0]], starts), pa.float64()),
                "score": pa.array(traverse(place, uniq_at, counts, arcs, fails), pa.float64()),
            }
        )

    return run


def score_documents(docs: DataFrame, train: Column, order: int = ORDER, mu: dict | None = None, chunk_bytes: int = CHUNK_BYTES, wide: int = WIDE_BITS, relay: int = RELAY) -> DataFrame:
    """One row for each row of docs(doc_id, text); train is true for rows to learn from."""
    ship(docs.sparkSession)
    docs = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(True)).alias("train")))
    rows, size = text_size(docs)
    size += rows
    bits = [bits_for(size // (6 * (4 if k == 1 else 1)), BUCKET_KEYS) for k in range(1, order + 1)]
    spaces = [word_space(bits[0], wide), *(Space(b, wide=wide) for b in bits[1:])]
    chunks = docs.select("doc_id", "text", "train", dealt(groups_for(size, chunk_bytes)).alias("chunk"))
    asks = chunks.groupBy("chunk").applyInArrow(_ask(spaces), asked_schema(1))
    answers, fine = lookup(asks, spaces, 1, relay)
    # the exchange of what is asked serves both: N and V are one row that goes with every answer
    totals = fine.groupBy("space", "bucket").applyInArrow(_count_words(spaces[0]), "tokens long, types long").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    answers = answers.crossJoin(F.broadcast(totals))
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(spaces, mu or MU), SCORES)
