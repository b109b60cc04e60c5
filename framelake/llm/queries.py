"""The subpackage's registered queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, decontaminate, langid, licenses, mixing, nearest, neighbours, prefix_trie, quality_rules, simhash, substring, urls, whiten
from .rows import add_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = brown.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ~remainder("doc_id", 7, 2))
    return scored.withColumn("held_out", ~F.col("train")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = neighbours.fit(docs, labels.where(~remainder("doc_id", 4, 2)))
    return neighbours.vote(docs, model).select("doc_id", remainder("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return add_columns(kept, "kept_sha256 string", lambda b: [pa.array(substring.kept_digest(b.column("kept_text")))]).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.train(docs, ~remainder("doc_id", 5, 0)))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", remainder("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def remainder(key: str, of: int, is_: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key doesn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == is_, F.lit(False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_decontaminate, op3_mix, op4_urls, op5_licenses, op6_quality_rules, op7_brown, op8_neighbours, op9_substring, op10_langid, op11_nearest, op12_prefix_trie, op13_whiten)
}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_PLAIN.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_PLAIN.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
),
hit AS (SELECT doc_id, i, win.n, item_id FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op5() -> str:
    phrases = ", ".join(f"('{p}', '{x}')" for p, x in licenses.PHRASES.items())
    templates = ", ".join(f"([{', '.join(repr(w) for w in t)}], '{x}', {need}, {block})" for t, x, need, block in licenses.template_rows())
    return f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({_PLAIN.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
p(phrase, label) AS (VALUES {phrases}),
place_of AS (
  SELECT doc_id, label, i - 1 AS place
  FROM (SELECT doc_id, w, phrase, label, len(string_split(phrase, ' ')) AS n, unnest(generate_series(1, len(w) - len(string_split(phrase, ' ')) + 1)) AS i FROM d, p WHERE len(w) >= len(string_split(phrase, ' ')))
  WHERE array_to_string(w[i:i + n - 1], ' ') = phrase
),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place_of GROUP BY doc_id),
t(template, label, need, block) AS (VALUES {templates}),
near AS (SELECT doc_id, w, t.* FROM d, t WHERE len(list_intersect(w, template)) >= need),
place AS (SELECT *, unnest(generate_series(1, len(w))) AS i FROM near),
hit AS (
  SELECT doc_id, label, n / CAST(len(template) AS DOUBLE) AS c
  FROM (SELECT doc_id, label, template, need, len(list_intersect(w[i:i + block - 1], template)) AS n FROM place WHERE list_contains(template, w[i])) WHERE n >= need
),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place_of UNION ALL SELECT doc_id, label FROM hit) GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""


_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS k FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS k FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS s FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""



def _op6() -> str:
    q = quality_rules
    kinds = ["[a-z]", "[A-Z]", r"[^\x00-\x7F]", "[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?''\"()\-]"]
    counted = ", ".join(f"len(regexp_extract_all(t, '{k}'))" for k in kinds)
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
again AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS k FROM twice) GROUP BY r),
line AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
b AS (
  SELECT r, doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(line.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
    len(w) < {q.MIN_WORDS} OR 100 * coalesce(again.n, 0) > {q.MAX_REPEATED} * len(w) AS base_failed
  FROM d LEFT JOIN again USING (r) LEFT JOIN line USING (r)
),
word AS (SELECT r, {_PLAIN.format("x")} AS x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM b) GROUP BY ALL),
counts AS (SELECT lang, x, sum(n) AS n FROM word JOIN b USING (r) WHERE NOT base_failed AND lang IS NOT NULL GROUP BY ALL),
sizes AS (SELECT lang, sum(n_words) AS size, count(*) AS docs FROM b WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang),
known AS (SELECT lang, size FROM sizes WHERE docs >= {q.REFERENCE_DOCS} AND size >= {q.REFERENCE_WORDS} AND size >= {q.REFERENCE_SHARE} * (SELECT sum(size) FROM sizes) ORDER BY size DESC, lang LIMIT {q.LANGUAGES}),
common AS (SELECT counts.lang AS of, x, counts.n / CAST(size AS DOUBLE) AS q FROM counts JOIN known USING (lang) WHERE counts.n >= {q.COMMON} * size),
refs AS (SELECT of, 1 - sum(q) AS rest, sum(q) AS held FROM common GROUP BY of),
kind AS (SELECT r, lang, base_failed, n_words, k, c FROM (SELECT r, lang, base_failed, n_words, unnest(range(0, 7)) AS k, unnest(list_append(c, length(t) - list_sum(c))) AS c FROM (SELECT *, [{counted}] AS c FROM b))),
own AS (SELECT r, k, c / greatest(sum(c) OVER (PARTITION BY r), 1e-12::DOUBLE) AS p FROM kind),
whole AS (SELECT lang AS of, k, sum(c) / CAST(sum(sum(c)) OVER (PARTITION BY lang) AS DOUBLE) AS q FROM kind WHERE NOT base_failed AND lang IN (SELECT of FROM refs) GROUP BY lang, k),
asked AS (SELECT r, n_words, of, rest, held FROM b, refs WHERE of = lang OR lang IS NULL OR lang NOT IN (SELECT of FROM refs)),
by_kind AS (SELECT r, of, sqrt(greatest(0, sum({term("p", "q")} + {term("q", "p")}) / 2)) AS d FROM asked JOIN own USING (r) JOIN whole USING (of, k) GROUP BY r, of),
met AS (SELECT r, common.of, word.n / CAST(n_words AS DOUBLE) AS p, q FROM asked JOIN word USING (r) JOIN common ON common.of = asked.of AND common.x = word.x),
sums AS (SELECT r, of, sum(p) AS p, sum(q) AS q, sum({term("p", "q")} + {term("q", "p")}) AS s FROM met GROUP BY r, of),
by_word AS (
  SELECT r, of, sqrt(greatest(0, (s + held - q + {term("op", "rest")} + {term("rest", "op")}) / 2)) AS d
  FROM (SELECT asked.r, asked.of, rest, held, coalesce(s, 0) AS s, coalesce(q, 0) AS q, CASE WHEN n_words > 0 THEN greatest(0, 1 - coalesce(p, 0)) ELSE 0 END AS op FROM asked LEFT JOIN sums ON sums.r = asked.r AND sums.of = asked.of)
),
near AS (
  SELECT r, bool_or((k.d <= {q.CLASS_DISTANCE} OR n_words < {q.CLASS_WORDS}) AND (w.d <= {q.COMMON_DISTANCE} OR n_words < {q.COMMON_WORDS})) AS fine
  FROM asked JOIN by_kind k USING (r, of) JOIN by_word w USING (r, of) GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (coalesce(fine, false) OR NOT EXISTS (SELECT 1 FROM refs)) AS kept FROM b LEFT JOIN near USING (r)
"""


#: CRC-32 of a number in decimal: each byte, then eight shifts.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda k: list_concat([CAST(ascii(k) AS BIGINT)], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

_OP12 = rf"""
WITH t AS (
  SELECT conv_id AS c, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS name, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens, turn, coalesce(role, '') AS role
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT c, list(struct_pack(name := name, tokens := tokens) ORDER BY turn NULLS FIRST, role, name) AS w FROM t GROUP BY c),
seq AS (
  SELECT a.c, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w
  FROM (SELECT *, {_CRC} % 4 AS h FROM own) a LEFT JOIN own b ON b.c = a.c - a.c % 20
),
member AS (SELECT c, d, array_to_string(list_transform(w[1:d], lambda x: x.name), ',') AS key, CASE WHEN d > 0 THEN w[d].tokens ELSE 0 END AS tokens, d = len(w) AS last FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM seq)),
node AS (SELECT key, d, min(c) AS c, count(*) AS n, max(tokens) AS tokens, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends FROM member GROUP BY key, d),
child AS (SELECT node.key, m.key AS parent FROM node JOIN member m ON m.c = node.c AND m.d = node.d - 1),
size AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN (SELECT parent, count(*) AS k FROM child GROUP BY parent) s ON s.parent = node.key),
total AS (SELECT m.key, count(*) FILTER (k = 0) AS leaves, CAST(sum((n - 1) * size.tokens) AS BIGINT) AS saved FROM size JOIN member m ON m.c = size.c AND m.d <= size.d GROUP BY m.key)
SELECT size.c AS conv_id, CAST(size.d AS BIGINT) AS depth, up.c AS parent_conv_id, size.n AS n_convs, size.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(size.ends) AS ends_sha256
FROM size JOIN total USING (key) LEFT JOIN child USING (key) LEFT JOIN node up ON up.key = child.parent
"""

#: SQL for those that it can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op2_decontaminate": _OP2, "op5_licenses": _op5(), "op6_quality_rules": _op6(), "op9_substring": _OP9, "op12_prefix_trie": _OP12}
