"""The line lengths that the README gives for shingles of 8 characters."""

import pytest

from shelfspark.llm import line_dedup as L


@pytest.mark.parametrize("edits,least", [(["middle"], 79), (["word"], 115), (["third", "twothirds"], 151), (["end"], 11)])
def test_least_length_of_a_link(rng, edits, least):
    def linked(n):
        x = "".join(chr(0x4E00 + i) for i in rng.sample(range(5000), n))  # no shingle twice
        y = list(x)
        for e in edits:
            at = {"middle": n // 2, "word": n // 2, "third": n // 3, "twothirds": 2 * n // 3, "end": n}[e]
            y[at : at + (5 if e == "word" else 1)] = "vwxyz"[: 5 if e == "word" else 1]
        a, b = (set(L.char_shingles([t])[0].tolist()) for t in (x, "".join(y)))
        return len(a & b) >= L.THRESHOLD * len(a | b)

    assert linked(least) and not linked(least - 1)
