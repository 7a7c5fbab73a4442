"""Language identification by a linear-chain conditional random field.

Each word of a text is labelled with a language.  Emissions add up weights of
hashed features of the word: its character n-grams with the word's ends marked
(those that touch an end are the affixes) and the word itself (the lexicon).
Transitions between the labels of neighbouring words are learned with them, on
word sequences in which runs of words from documents of different languages
follow each other, so that code-switched texts are labelled run by run.
Forward-backward gives the posterior of each word; a document takes the
language with the largest mean posterior over its words that have a letter,
and that mean is its score.

The model is fitted on the driver, on at most ``per_language`` labelled rows a
language, those of the least hashes of id and text (rows equal in both count
once); all rows are labelled, whole texts, in their own tasks.  Long texts are
cut into segments whose transfer matrices are combined, which gives the same
posteriors as one pass from end to end.  Emissions are single precision.

Defined results.  A null text and one without a letter: ``und``, score 0.
Nothing to learn from: ``und``, score 0 for all.  Equal sums: the language
first in the alphabet.  Repeated rows and null ids get a row each.  Labels are
read from the training rows only.  Columns of the input that are named like the
result's are replaced by them; ``names`` gives the result others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from shelfspark.llm.common import by_texts, map_texts, mix, own_columns, ship, tidied

UNKNOWN = "und"
PER_LANGUAGE = 120
BITS = 17  # weights are hashed to 2**BITS places
NGRAMS = (2, 3, 4)
SEGMENT = 64
ROUNDS = 40
_A = 0x9E3779B97F4A7C15
_C = np.uint64(_A)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of each feature, number of features of each word); words without a letter have none."""
    marked = ["^" + w + "$" for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer(("".join(marked) + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(owner))  # characters to the end of the word
    grams, h = [], codes
    where, own = [], []
    for n in range(2, max(NGRAMS) + 1):
        h = h[:-1] * _C + codes[n - 1 : n - 1 + len(h) - 1]
        if n in NGRAMS:
            ok = left >= n
            grams.append(mix(h[: len(owner)][ok] + np.uint64(n)))
            own.append(owner[ok])
    grams.append(np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)))
    own.append(np.arange(len(words)))
    where, own = np.concatenate(grams) >> np.uint64(64 - BITS), np.concatenate(own)
    letter = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
    keep = letter[own]
    where, own = where[keep], own[keep]
    order = np.argsort(own, kind="stable")
    return where[order].astype(np.int64), np.bincount(own, minlength=len(words))


def sum_by_word(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over each word's features; 0 for words without any."""
    out = np.zeros((len(counts), values.shape[1]), dtype=values.dtype)
    full = counts > 0
    if full.any():
        ends = np.cumsum(counts)
        out[full] = np.add.reduceat(values, (ends - counts)[full], axis=0)
    return out


class Chain:
    """Forward-backward over many word sequences at once."""

    def __init__(self, lens: np.ndarray, transitions: np.ndarray):
        self.a = np.exp(transitions - transitions.max())
        segs = -(-lens // SEGMENT)
        self.seq = np.repeat(np.arange(len(lens)), segs)  # of each segment
        self.nth = np.arange(len(self.seq)) - np.repeat(np.cumsum(segs) - segs, segs)
        self.start = np.repeat(np.cumsum(lens) - lens, segs) + self.nth * SEGMENT
        self.len = np.minimum(SEGMENT, np.repeat(lens, segs) - self.nth * SEGMENT)
        self.total = int(lens.sum())
        self.last = np.repeat(segs, segs) - 1 == self.nth

    def run(self, emission: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(posteriors of each word, expected transitions) for positive emissions."""
        a, k, s = self.a, emission.shape[1], len(self.seq)
        if not s:
            return np.zeros((0, k)), np.zeros((k, k)) if pairs else None
        at = np.minimum(self.start[:, None] + np.arange(SEGMENT), self.total - 1)
        e = emission[at]
        steps = int(self.len.max())
        kind = emission.dtype
        a = a.astype(kind)
        m = np.tile(np.eye(k, dtype=kind), (s, 1, 1))
        for t in range(steps):
            live = self.len > t
            new = (m @ a) * e[:, t, None, :]
            new /= new.max(axis=(1, 2), keepdims=True)
            m = np.where(live[:, None, None], new, m)
        enter, leave = np.full((s, k), 1.0 / k, dtype=kind), np.ones((s, k), dtype=kind)
        order = np.argsort(self.nth, kind="stable")
        bounds = np.searchsorted(self.nth[order], np.arange(int(self.nth.max()) + 2))
        for j in range(1, len(bounds) - 1):
            i = order[bounds[j] : bounds[j + 1]]
            v = np.einsum("sk,skl->sl", enter[i - 1], m[i - 1])
            enter[i] = v / v.sum(axis=1, keepdims=True)
        for j in range(len(bounds) - 2, 0, -1):
            i = order[bounds[j] : bounds[j + 1]]
            v = np.einsum("skl,sl->sk", m[i], leave[i])
            leave[i - 1] = v / v.sum(axis=1, keepdims=True)
        alpha = np.empty((steps, s, k), dtype=kind)
        v = enter
        for t in range(steps):
            new = (v @ a) * e[:, t]
            new /= new.sum(axis=1, keepdims=True)
            v = np.where((self.len > t)[:, None], new, v)
            alpha[t] = v
        beta, out = leave, np.empty((self.total, k), dtype=kind)
        expected = np.zeros((k, k)) if pairs else None
        for t in range(steps - 1, -1, -1):
            live = self.len > t
            g = alpha[t] * beta
            g /= g.sum(axis=1, keepdims=True)
            out[self.start[live] + t] = g[live]
            scaled = e[:, t] * beta
            if pairs:
                before = alpha[t - 1] if t else enter
                w = live & ((t > 0) | (self.nth > 0))
                joint = before[w][:, :, None] * a[None] * scaled[w][:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            new = scaled @ a.T
            new /= new.sum(axis=1, keepdims=True)
            beta = np.where(live[:, None], new, beta)
        return out, expected


def emissions(logits: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(logits - logits.max(axis=1, keepdims=True), -50, 0))


def fit(rows: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 7) -> dict:
    """Weights and transitions from (text, language) rows, by AdaGrad on the likelihood."""
    langs = sorted({lang for _, lang in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    runs: list[tuple[list[str], int]] = []
    for text, lang in rows:
        w, i = words_of(text), 0
        while i < len(w):
            n = int(rng.integers(8, 200))
            runs.append((w[i : i + n], place[lang]))
            i += n
    runs = [runs[i] for i in rng.permutation(len(runs))]
    flat = [w for r, _ in runs for w in r]
    gold = np.repeat([y for _, y in runs], [len(r) for r, _ in runs]).astype(np.int64)
    k = max(1, len(langs))
    model = {"langs": langs, "w": np.zeros((1 << BITS, k)), "t": np.zeros((k, k))}
    if not flat:
        return model
    lens = np.full(-(-len(flat) // 512), 512)
    lens[-1] = len(flat) - 512 * (len(lens) - 1)
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in flat), np.int64, len(flat))
    where, counts = features(list(index))
    owner = np.repeat(np.arange(len(index)), counts)
    inside = np.ones(len(flat) - 1, dtype=bool)
    inside[np.cumsum(lens)[:-1] - 1] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][inside], gold[1:][inside]), 1)
    target = np.zeros((len(flat), k))
    target[np.arange(len(flat)), gold] = 1
    hist, hist_t, rate, decay = np.full(model["w"].shape, 1e-8), np.full((k, k), 1e-8), 0.5, 1e-4
    for _ in range(rounds):
        logits = sum_by_word(model["w"][where], counts)
        post, expected = Chain(lens, model["t"]).run(emissions(logits)[ids], pairs=True)
        miss = target - post
        by_word = np.stack([np.bincount(ids, weights=miss[:, j], minlength=len(index)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(where, weights=by_word[owner, j], minlength=1 << BITS) for j in range(k)], axis=1) / np.sqrt(len(flat))
        grad -= decay * model["w"]
        hist += grad * grad
        model["w"] += rate * grad / np.sqrt(hist)
        grad_t = (seen - expected) / np.sqrt(len(flat))
        hist_t += grad_t * grad_t
        model["t"] += rate * grad_t / np.sqrt(hist_t)
    model["w"] = model["w"].astype(np.float32)
    return model


def label_texts(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    langs = model["langs"]
    lists = [words_of(t) for t in texts]
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = [w for x in lists for w in x]
    preds, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not flat or not langs:
        return preds, scores
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    where, counts = features(list(index))
    e = emissions(sum_by_word(model["w"][where], counts))[ids]
    some = lens > 0
    post, _ = Chain(lens[some], model["t"]).run(e)
    letter = (counts > 0)[ids].astype(float)
    starts = (np.cumsum(lens) - lens)[some]
    n = np.add.reduceat(letter, starts)
    mean = np.add.reduceat(post * letter[:, None], starts, axis=0, dtype=np.float64) / np.maximum(n, 1)[:, None]
    for i, j, m in zip(np.flatnonzero(some), n, mean):
        if j:
            best = int(np.argmax(m))
            preds[i], scores[i] = langs[best], min(1.0, float(m[best]))
    return preds, scores


HASH_STEPS = 1 << 62


def share(per_language: int, rows: int) -> int:
    """Hashes of HASH_STEPS below which about twice per_language of so many rows lie."""
    wanted = 2 * per_language + 20
    return HASH_STEPS if rows <= wanted else HASH_STEPS * wanted // rows


def sampled(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, counts: dict[str, int] | None = None) -> DataFrame:
    """(lang, text): the rows of the least hashes of each language, per_language at most.

    A first cut by each language's share leaves about twice as many, whatever
    its size, so that hardly a text is moved to pick them; counts, rows by
    language, are counted if not given.
    """
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASH_STEPS))
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", h.alias("h"), "text")
    if counts is None:  # repeated rows do not count, a few percent do not matter; a row a language
        counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return rows.select("lang", "text").limit(0)
    cuts = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(share(per_language, n)))])
    near = rows.where(F.col("h") < cuts[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return near.withColumn("nth", nth).where(F.col("nth") <= per_language).orderBy("lang", "h").select("lang", "text")


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> dict:
    """Fit on at most per_language rows of each language of docs(doc_id, text, lang)."""
    return fit([(r["text"], r["lang"]) for r in sampled(docs, learn, per_language).collect()], rounds)


BATCH_BYTES = 1 << 20


def identify(docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score after its own columns."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # 2**BITS weights a language
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in {n.lower() for n in names}]
    docs = docs.select(*[own_columns(docs)[i] for i in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_texts(batches, BATCH_BYTES):
            preds, scores = label_texts(b.column("text").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "added0", "added1"])

    return map_texts(docs, tidied(run), [StructField(names[0], StringType()), StructField(names[1], DoubleType())])
