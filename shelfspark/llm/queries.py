"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import (
    binary_output,
    conversation_repair,
    decontaminate,
    filter_audit,
    language_id,
    license_scan,
    line_dedup,
    lm_scoring,
    minhash,
    packing,
    quality_rules,
    token_counts,
    url_filters,
)

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), fold(5) != 1)


def op5_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, end = "word_bpe_49k.json", 2
    folder, index = binary_output.write_records(table(spark, sf_dir, "documents"), name, end)
    read = binary_output.read_records(folder, index, name, end, digest=True)
    return binary_output.starts(read, index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 0, 2048)


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, fold(4) != 2)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op11_trie_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_redirects, op2_host_rules, op3_edit_matching, op4_backoff_automaton, op5_record_files, op6_best_two_fit, op7_weighted_minhash, op8_crf_language, op9_pretoken_counts, op10_fuzzy_lines, op11_trie_repair, op12_filter_audit, op13_license_rules, pipeline)
    return {f.__name__: f for f in found}


_OP1 = r"""
WITH RECURSIVE base AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
         unnest(CASE WHEN contains(url, '://') AND html IS NOT NULL
                     THEN list_concat([''], regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) ELSE [''] END) AS tag
  FROM pages),
told AS (
  SELECT url, CASE WHEN starts_with(lower(tag), '<link') THEN
                CASE WHEN list_contains(regexp_split_to_array(lower(trim(regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), E'"'' \t\n\x0b\x0c\r')), '\s+'), 'canonical')
                     THEN trim(regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), E'"'' \t\n\x0b\x0c\r') END
              WHEN lower(trim(regexp_extract(tag, '(?is)[\s"''/]http-equiv\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), E'"'' \t\n\x0b\x0c\r')) = 'refresh'
                THEN regexp_extract(trim(regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), E'"'' \t\n\x0b\x0c\r'),
                                    '(?is)^[\d.\s]*[;,\s]\s*(?:url\s*=\s*)?["'']?\s*([^"''\s]+)', 1) END AS t
  FROM base WHERE tag <> ''),
targets AS (SELECT url, replace(t, '&amp;', '&') AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)', 1) AS folder FROM told WHERE t <> ''),
links AS (
  SELECT url, CASE WHEN starts_with(t, '#') THEN url
                   WHEN contains(t, '://') THEN t
                   WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t
                   WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t
                   WHEN starts_with(t, '?') THEN regexp_extract(url, '(?s)^([^?#]*)', 1) || t
                   WHEN ends_with(folder, '/') THEN folder || t
                   ELSE folder || '/' || t END AS full_url
  FROM targets),
named AS (
  SELECT u, translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || CASE WHEN starts_with(way, '/') AND contains(way, '/.')
                    THEN list_reduce(string_split(way, '/')[2:], lambda acc, x: CASE x WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END, '')
                         || CASE WHEN regexp_matches(way, '/\.\.?$') THEN '/' ELSE '' END || substring(rest, length(way) + 1)
                    ELSE rest END AS node
  FROM (SELECT *, split_part(rest, '?', 1) AS way
        FROM (SELECT u, head, substring(split_part(u, '#', 1), length(head) + 1) AS rest
              FROM (SELECT u, regexp_extract(split_part(u, '#', 1), '(?s)^.*?://[^/?#]*', 0) AS head
                    FROM (SELECT url AS u FROM pages UNION SELECT full_url FROM links) WHERE contains(u, '://'))))),
edges AS (SELECT x.node AS a, y.node AS b FROM links JOIN named x ON links.url = x.u JOIN named y ON links.full_url = y.u WHERE x.node <> y.node),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON reach.m = both_ways.a),
nodes AS (
  SELECT DISTINCT n,
         translate(regexp_extract(n, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(n, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM reach),
rules(rule, rule_host, rule_path, act) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
said AS (
  SELECT n, arg_max(act, length(rule)) AS act FROM nodes JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n),
spread AS (
  SELECT reach.n FROM reach JOIN said ON reach.m = said.n GROUP BY reach.n
  HAVING bool_or(said.act = 'block') AND NOT bool_or(said.act = 'allow')),
own AS (
  SELECT page_id, url, host, path, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act
  FROM (SELECT DISTINCT page_id, url, host, path FROM base) b JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, url, host, path)
SELECT base.page_id, base.host, base.path, own.rule, coalesce(own.act, CASE WHEN spread.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM base LEFT JOIN own ON base.page_id IS NOT DISTINCT FROM own.page_id AND base.url IS NOT DISTINCT FROM own.url
LEFT JOIN named ON base.url = named.u
LEFT JOIN spread ON named.node = spread.n
WHERE base.tag = ''
"""

_OP2 = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS d(k) GROUP BY r),
measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN repeats USING (r)),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
rates AS (
  SELECT source, CASE WHEN v <= 1e-12 THEN m ELSE (f + m * greatest(0, m * (1 - m) / v - 1)) / (n + greatest(0, m * (1 - m) / v - 1)) END AS rate
  FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(rate > 0.5, false) AS host_failed, NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept
FROM judged LEFT JOIN rates USING (source)
"""


def _least(*found: str) -> str:
    return f"list_min([{', '.join(found)}])"


def _more(state: str, cost: str, letter: str, row: str = "") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o{' || ' + row if row else ''}}}"


def _op11() -> str:
    """States 0 to 3 as in conversation_repair, each {cost, audit, rows so far}; before each row and at the end a step inserts rows."""
    s = [f"acc.s{i}" for i in range(4)]
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    once = {2: [_more(x, "5", "I", user) for x in (s[0], s[1], s[3])], 3: [_more(s[2], "5", "I", assistant)]}
    twice = {2: [_more(s[2], "10", "II", f"{assistant} || {user}")], 3: [_more(x, "10", "II", f"{user} || {assistant}") for x in (s[0], s[1], s[3])]}
    inserted = f"{{'s0': {s[0]}, 's1': {s[1]}, 's2': {_least(s[2], *once[2], *twice[2])}, 's3': {_least(s[3], *once[3], *twice[3])}}}"
    stay, extra = "WHEN x.fault IN ('blank', 'duplicate') THEN 1000000000", "CASE WHEN x.fault = 'truncated' THEN 5 ELSE 0 END"
    kept = lambda state, initial: _more(state, f"CASE {stay} WHEN x.initial = '{initial}' THEN {extra} ELSE 1000000000 END", "K", "chr(10) || x.role || ':' || x.text")
    named = lambda state, role: _more(state, f"CASE {stay} ELSE 1 + {extra} END", "R", f"chr(10) || '{role}:' || x.text")
    gone = lambda state: _more(state, "2", "D")
    edited = (
        f"{{'s0': {gone(s[0])}, 's1': {_least(gone(s[1]), kept(s[0], 's'))}, "
        f"'s2': {_least(gone(s[2]), *[f(x, y) for x in (s[0], s[1], s[3]) for f, y in ((kept, 'u'), (named, 'user'))])}, "
        f"'s3': {_least(gone(s[3]), kept(s[2], 'a'), named(s[2], 'assistant'))}}}"
    )
    return rf"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                         lambda crc, b: list_reduce([CAST(i AS BIGINT) FOR i IN range(8)], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, xor(crc, b)),
                         CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS d
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM base WHERE d <> 0),
placed AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged),
judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'initial': initial, 'role': role, 'text': text, 'fault': fault}} ORDER BY i) AS l
  FROM judged GROUP BY conv_id),
walked AS (
  SELECT *, list_reduce(flatten(list_transform(l, lambda x: [{{'initial': '', 'role': '', 'text': '', 'fault': 'insert'}}, x])) || [{{'initial': '', 'role': '', 'text': '', 'fault': 'insert'}}],
      lambda acc, x: CASE WHEN x.fault = 'insert' THEN {inserted} ELSE {edited} END,
      {{'s0': {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}}, 's1': {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}}, 's2': {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}}, 's3': {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}}}}) AS w
  FROM told),
ended AS (SELECT *, list_min([w.s0, w.s3]) AS best FROM walked)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substring(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended ON c.conv_id IS NOT DISTINCT FROM ended.conv_id
"""


_OP12 = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
flagged AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least.least THEN 'E' ELSE '' END AS fails
  FROM texts JOIN least USING (text)),
told AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM flagged LEFT JOIN told USING (doc_id) GROUP BY part, fails),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS own, left(filter_order, s - 1) AS before FROM orders, range(1, 6) AS r(s)),
met AS (SELECT part, filter_order, step, own, n, good, bad, fails, contains(fails, own) AS has, translate(fails, before, '') <> fails AS earlier FROM counts, steps),
done AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT has AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (has AND NOT earlier), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (has AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (has AND NOT earlier), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (has AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM done
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_redirects": _OP1, "op2_host_rules": _OP2, "op11_trie_repair": _op11(), "op12_filter_audit": _OP12}
