"""License scans by ordered signature rules.

A text is brought to lower-case words joined by one space.  The words that
are some rule's keyword choose the rules to try; each gives detections
(first word, word after the last, rule).  Overlaps are resolved by priority
and containment: a detection within the interval of one of a better priority,
or within a longer one (or an equal one of an earlier rule) of its own, is
suppressed; detections that overlap in part both stay.  Labels of the three
base phrases stay in any case.

The score is 1 - the product of (1 - weight) over the labels, with each
label's largest weight; a base label weighs at least as much as a notice.

Rows are independent: no shuffle, no row is held longer than its batch.

Defined results.  A null text is empty: no words, no labels (empty strings),
score 0.  Upper case outside of A-Z stays.  Repeated rows count each.  Of the
input only doc_id and text are read.  No rows: no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import by_texts, ship, tidied
from shelfspark.llm.license_rules import RULES, WEIGHTS, Rule

#: Phrases with their labels, given by the contract.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BY_KEYWORD: dict[bytes, list[Rule]] = {}
for _rule in RULES:
    _BY_KEYWORD.setdefault(_rule.keyword, []).append(_rule)
_KEYWORDS = frozenset(_BY_KEYWORD)


def places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Where a phrase's words stand in ``" word word "``, also where two places share words."""
    sought, at = b" " + phrase + b" ", -1
    while (at := line.find(sought, at + 1)) >= 0:
        yield at + 1


def detections(line: bytes, words: set[bytes]) -> list[tuple[int, int, Rule]]:
    """(begin, end, rule) of all rules whose keyword is among the words."""
    tried = sorted((r for k in _KEYWORDS & words for r in _BY_KEYWORD[k]), key=lambda r: r.no)
    return [(m.start(), m.end(), r) for r in tried for m in r.pattern.finditer(line)]


def resolved(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no other suppresses."""
    kept: list[tuple[int, int, Rule]] = []
    for level in range(len(WEIGHTS)):
        better = sorted(kept, key=lambda d: d[0])
        begins = [d[0] for d in better]
        reach = np.maximum.accumulate([d[1] for d in better]).tolist() if better else []
        end = -1
        for d in sorted((d for d in found if d[2].priority == level), key=lambda d: (d[0], -d[1], d[2].no)):
            if d[1] <= end:  # within one that begins no later
                continue
            end = d[1]
            i = bisect_right(begins, d[0])
            if not i or reach[i - 1] < d[1]:
                kept.append(d)
    return kept


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    words = text.translate(_TABLE).split()
    line = b" " + b" ".join(words) + b" "
    distinct = set(words)
    base = [(at, label) for phrase, label in BASE if phrase.split()[0] in distinct for at in places(line, phrase)]
    weight = dict.fromkeys((label for _, label in base), WEIGHTS[-1])
    for _, _, r in resolved(detections(line, distinct)):
        weight[r.label] = max(weight.get(r.label, 0.0), WEIGHTS[r.priority])
    first = last = None
    if base:
        begins = [at for at, _ in base]
        first, last = (line.count(b" ", 0, at) - 1 for at in (min(begins), max(begins)))
    miss = 1.0
    for label in sorted(weight):
        miss *= 1.0 - weight[label]
    return len(words), len(base), first, last, ",".join(sorted({label for _, label in base})), ",".join(sorted(weight)), 1.0 - miss


FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [x.split()[0] for x in FOUND.split(", ")]
    for b in by_texts(batches):
        rows = [scan(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Base places and labels of each row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_scanned), FOUND)
