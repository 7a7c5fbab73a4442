import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from oracle import SMALL

from shelfspark.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
FITS = re.compile(r"(s?(ua)+)?\Z")


@lru_cache(None)
def every(n: int) -> list:
    """All audits with n letters that are not I and two I at most, each with what the inserted and reroled rows may be."""
    if n == 0:
        return ["", "I", "II"]
    return [a + "I" * k + e for a in every(n - 1) for e in "KRD" for k in range(3) if a.count("I") + k <= 2 and not (k and a.endswith("I"))]


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, list]:
    """Least (cost, audit) with the repaired rows, by trying all; rows: (role, fault, text)."""
    best = None
    audits = {a + "I" * k for a in every(len(rows)) for k in range(3)} if rows else {""}
    for audit in audits:
        if audit.count("I") > 2:
            continue
        outs = [(0, [])]
        rest = iter(rows)
        for e in audit:
            if e == "I":
                outs = [(c + 5, o + [(r, "")]) for c, o in outs for r in ("user", "assistant")]
                continue
            role, fault, text = next(rest)
            extra = 5 if fault == "truncated" else 0
            if e == "D":
                outs = [(c + 2, o) for c, o in outs]
            elif fault in ("blank", "duplicate"):
                outs = []
            elif e == "K":
                outs = [(c + extra, o + [(role, text)]) for c, o in outs]
            else:
                outs = [(c + 1 + extra, o + [(r, text)]) for c, o in outs for r in ("user", "assistant")]
        for c, o in outs:
            if FITS.match("".join(r[:1] or " " for r, _ in o)) and (best is None or (c, audit) < best[:2]):
                best = (c, audit, o)
    return best


def brute(conversations: list[tuple]) -> dict:
    found = {}
    for conv in {r[0] for r in conversations}:
        rows = []
        for c, turn, role, text, *_ in (r for r in conversations if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            d = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
            rows += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, out = cheapest([(r[1], f, r[2]) for r, f in zip(rows, faults)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha, out)
    return found


def some(rng, n: int, rows: int) -> list[tuple]:
    out = []
    for c in range(n):
        for i in range(rng.randint(0, rows)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            out.append((c if c else None, rng.choice([i, i, i, 2, None]), role, rng.choice(["Yes.", "Well", "é! \n", " \t", None, f"{i}?"]), "x"))
    return out + out[:3]


def check(spark, rows, size):
    found = brute(rows)
    damaged = R.damage(spark.createDataFrame(rows, SCHEMA).repartition(3))
    audits = R.audits(damaged, size)
    out = {r.conv_id: (*[r[c] for c in R.STATS], r.audit, r.repaired_sha256) for r in R.repaired_digest(damaged, audits).collect()}
    assert out == {c: v[:-1] for c, v in found.items()}
    texts = {}
    for r in sorted(R.repaired(damaged, audits).collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.place)):
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    assert texts == {c: v[-1] for c, v in found.items() if v[-1]}


def test_whole_conversations(spark, rng):
    check(spark, some(rng, 60, 5), R.SEGMENT)


@pytest.mark.parametrize("size", [1, 2])
def test_segments_of_long_conversations(spark, rng, size):
    check(spark, some(rng, 30, 5), size)


def test_long_conversation_in_segments(spark):
    rows = [(7, i, ("user", "assistant", "user")[i % 3], f"{i % 900}" + "." * (i % 5 > 0), "") for i in range(3000)]
    damaged = R.damage(spark.createDataFrame(rows, SCHEMA))
    whole, cut = ([tuple(r) for r in R.repair(damaged, n).collect()] for n in (R.SEGMENT, 100))
    assert whole == cut and len(whole[0][7]) > 2500


def test_trie_shares_layers(monkeypatch):
    """Each trie node is computed once: three keys with a common beginning take as many steps as there are distinct prefixes."""
    calls = []
    monkeypatch.setattr(R, "step", lambda layer, symbol, real=R.step: calls.append(symbol) or real(layer, symbol))
    keys = sorted(["0uaua", "0uauA", "0uax"])
    assert [k for k, *_ in R.solve_sorted(iter(keys))] == keys
    assert len(calls) == len({k[:i] for k in keys for i in range(2, len(k) + 1)})


def test_no_rows_and_very_long_text(spark):
    assert R.repair(R.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    check(spark, [(3, 1, "user", "é long. " * 200_000, None), (3, 2, "assistant", "x" * 1_000_000 + "!", None)], R.SEGMENT)


def test_query(spark):
    from shelfspark.llm import queries

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    got = queries.op11_trie_repair(spark, SMALL).collect()
    assert {r.conv_id for r in got} == {r[0] for r in rows} and len(got) == len({r[0] for r in rows})
