"""The queries themselves, on whole small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SMALL
from tests_llm_tools import sentence

from shelfspark.llm import common, lm_scoring, queries, token_counts
from shelfspark.llm.tokenizer_cache import load

Q = queries.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_finds_what_holds_an_item(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {i for i, d in docs.items() if any(x and x in (d.text or "") for x in items)}
    got = {r.doc_id for r in Q["op3_edit_matching"](spark, SMALL).collect()}
    assert want and want <= got <= set(docs)


def test_op10_and_op7_give_a_row_a_document(spark, docs):
    for name in ("op7_weighted_minhash", "op10_fuzzy_lines"):
        got = Q[name](spark, SMALL).select("doc_id").collect()
        assert sorted(r.doc_id for r in got) == sorted(docs), name
    same = defaultdict(set)
    for r in Q["op7_weighted_minhash"](spark, SMALL).collect():
        same[docs[r.doc_id].text].add(r.class_id)
    assert all(len(c) == 1 for c in same.values())


def test_op4_base_scores(spark, docs):
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) + [None] for i, r in docs.items()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(t for i in docs if i not in held for t in toks[i])
    n, v = sum(c.values()), len(c)
    better = 0
    for r in Q["op4_backoff_automaton"](spark, SMALL).collect():
        want = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(toks[r.doc_id]), sum(c[t] > 0 for t in toks[r.doc_id]), n)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        better += r.score > r.base_score
    assert better > 0.7 * len(docs)


def test_op5_digests(spark, docs):
    t, start, want = load("word_bpe_49k.json"), 0, {}
    for i in sorted(docs):
        ids = t.encode(docs[i].text or "", add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q["op5_record_files"](spark, SMALL).collect()} == want


def test_op6_pieces(spark, docs):
    t, pieces, bins = load("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in Q["op6_best_two_fit"](spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, d in docs.items():
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and len(own) == -(-len(ids) // 2048)
        assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in own)
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) * 1.02 + 1


def test_op8_columns(spark, docs):
    langs = {d.lang for d in docs.values() if d.lang} | {"und"}
    right = seen = 0
    for r in Q["op8_crf_language"](spark, SMALL).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.lang_pred in langs and 0 <= r.score <= 1
        if r.held_out and docs[r.doc_id].lang:
            seen, right = seen + 1, right + (r.lang_pred == docs[r.doc_id].lang)
    assert right >= 0.9 * seen


def test_op9_counts(spark, docs):
    t = load("byte_bpe_50k.json")
    want = {i: (len((d.text or "").encode()), len(t.encode(d.text or "", add_special_tokens=False).ids)) for i, d in docs.items()}
    got = Q["op9_pretoken_counts"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_shuffled_inputs_are_settled(spark, rng):
    """What goes by a row's place is fixed by a table where a shuffle comes before, and the results are the same."""
    rows = [(i, sentence(rng, rng.randint(0, 80))) for i in range(120)] + [(5, "the same")] * 200
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    mixed = plain.repartition(7, "text")
    assert common.settled(plain) is plain and "Exchange" not in common.settled(mixed)._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(map(tuple, df.collect()))
    small = {"chunk_bytes": 4000}
    assert key(token_counts.count_tokens(mixed, "byte_bpe_50k.json", **small)) == key(token_counts.count_tokens(plain, "byte_bpe_50k.json", **small))
    scores = [{(r[0], *r[2:5], round(r.score, 6)) for r in lm_scoring.score_documents(df, queries.fold(5) != 1, **small).collect()} for df in (mixed, plain)]
    assert scores[0] == scores[1]


def test_other_pre_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE())
    t.pre_tokenizer = pre_tokenizers.Digits()
    t.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError, match="Digits"):
        token_counts._tools(str(tmp_path / "other.json"))
