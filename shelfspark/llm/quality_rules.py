"""Host-level quality rules.

Each document is measured and judged by base rules; failures are summed up by
host (the ``source`` column), the hosts' failure rates are shrunk with a beta
prior fitted to all hosts by the method of moments, and hosts whose shrunk
rate is over the limit lose all their documents.  DataFrame operations only:
a document is measured within its own row, and what is shuffled are the few
numbers of a row, combined by host before.

Shrunk rate of a host with f failures in n documents:
(f + m * s) / (n + s), with m the mean and v the variance of the hosts' rates
and s = m * (1 - m) / v - 1, at least 0.  If all hosts have one rate (v = 0)
the prior decides: the rate is m.

Defined results.  A null or empty text has no words and fails.  Documents with
a null source belong to no host and are judged by the base rules alone.
Repeated rows count each.  No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACE, write_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, not again in each place that reads it."""
    return df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias(f"_{name}")).select("*", F.col(f"_{name}.v").alias(name)).drop(f"_{name}")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce("text", F.lit(""))
    words = F.split(F.btrim(text, F.lit(_WHITE)), SPACE)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", "source", text.alias("text"))
    df = df.select("*", (F.length(F.translate("text", _WHITE, "")) > 0).alias("any"), F.length(F.translate("text", _WHITE, "")).alias("word_chars"), (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).alias("n_symbols"))
    df = _held(df, "lines", lines).select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines")).drop("lines")
    df = _held(df, "w", F.when(F.col("any"), words).otherwise(F.array().cast("array<string>"))).drop("text")
    n = F.size("w")
    w = F.col("w")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("doc_id", "source", "word_chars", "n_symbols", "n_dup_lines", n.alias("n_words"), grams.alias("g"))
    df = _held(df, "h", F.col("g")).drop("g")
    # sorted with their places, equal windows are neighbours
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = _held(df, "s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed)).drop("h")
    s, last = F.col("s"), F.size("s") - 1
    twin = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["x"] == x["x"])) | ((i < last) & (s[F.least(i + 1, last)]["x"] == x["x"]))
    at = F.sort_array(F.transform(F.filter("s", twin), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda a, i: F.struct(i.alias("p"), (a["n"] + F.least(F.lit(3), i - a["p"])).alias("n")), lambda a: a["n"])
    return df.select(
        "doc_id", "source", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def host_rates(judged: DataFrame) -> DataFrame:
    """(source, host_docs, host_failed, host_rate) from judged(source, base_failed)."""
    hosts = judged.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    hosts = write_table(hosts, "hosts")
    r = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(r).alias("m"), F.var_pop(r).alias("v")).first()  # two numbers
    m, v = prior["m"] or 0.0, prior["v"] or 0.0
    if v <= 1e-12:
        return hosts.withColumn("host_rate", F.lit(float(m)))
    s = max(0.0, m * (1 - m) / v - 1)
    return hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(m * s)) / (F.col("host_docs") + F.lit(s)))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The measures of each row of docs(doc_id, text, source), base_failed, host_failed and kept."""
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    rows = write_table(measure(docs).withColumn("base_failed", failed), "measured")
    bad = host_rates(rows).where(F.col("host_rate") > max_host_rate).select("source", F.lit(True).alias("host_failed"))
    out = rows.join(bad, "source", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed"]
    return out.select(*cols, (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
