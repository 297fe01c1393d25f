"""Queries of dictionary passes over whole texts: a user's stresses, hard vowels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import homographs as H
from ..operators import stresspass as P
from .registry import _WORDS_SQL, _t, query

_BENCH_SQL = f"SELECT item_id, lower(unnest({_WORDS_SQL.format('text')})) AS w FROM benchmark"


def _bench(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.explode(H.words_of(F.col("text"))).alias("w")).select("item_id", F.lower("w").alias("w")).where(F.col("w").rlike(r"^\p{L}+$"))


def _hyphened(spark, sf_dir):
    """The texts with a hyphen in place of the space after "de", "and" and "die"."""
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.regexp_replace("text", " (de|and|die) ([a-z])", " $1-$2").alias("text"))


_TEXT_SQL = r"SELECT doc_id, regexp_replace(text, ' (de|and|die) ([a-z])', ' \1-\2', 'g') AS text FROM documents WHERE text IS NOT NULL"
_PARTS_SQL = r"""
p AS (SELECT doc_id, generate_subscripts(gs, 1) AS i, unnest(gs) AS gap, unnest(list_concat(ws, [''])) AS token FROM (SELECT doc_id, string_split_regex(text, '{0}') AS gs, regexp_extract_all(text, '{0}') AS ws FROM t))"""


@query(rf"""
WITH t AS ({_TEXT_SQL}), {_PARTS_SQL.format(r'[\p{{L}}+]+(?:-[\p{{L}}+]+)*'.replace('{{', '{').replace('}}', '}'))},
dict AS (SELECT w, min(w[1:item_id % length(w)] || '+' || w[item_id % length(w) + 1:]) AS v FROM ({_BENCH_SQL}) WHERE regexp_full_match(w, '\p{{L}}+') AND length(w) > 1 GROUP BY w
  UNION ALL SELECT 'de-la', 'de-l+a' UNION ALL SELECT 'and-the', '+and-the'),
s AS (SELECT doc_id, i, gap, token, generate_subscripts(ps, 1) AS j, unnest(ps) AS part FROM (SELECT *, CASE WHEN lower(token) IN (SELECT w FROM dict) THEN [token] ELSE string_split(token, '-') END AS ps FROM p)),
c AS (SELECT s.*, v, replace(v, '+', '') AS plain, strpos(v, '+') AS plus FROM s LEFT JOIN dict ON w = lower(part)),
m AS (SELECT *, array_to_string(list_transform(range(1, length(plain) + 1), lambda k: CASE WHEN part[k] = lower(part[k]) AND part[k] <> upper(part[k]) THEN lower(plain[k]) ELSE upper(plain[k]) END), '') AS x FROM c),
w AS (SELECT doc_id, i, any_value(gap) AS gap, string_agg(CASE WHEN v IS NULL THEN part ELSE x[1:plus - 1] || '+' || x[plus:] END, '-' ORDER BY j) AS word FROM m GROUP BY doc_id, i)
SELECT doc_id, string_agg(gap || word, '' ORDER BY i) AS stressed FROM w GROUP BY doc_id
""")
def user_stresses(spark, sf_dir):
    """The whole texts, some words joined by hyphens, with the stresses of a dictionary made from the benchmark."""
    w = _bench(spark, sf_dir).where(F.length("w") > 1)
    at = (F.col("item_id") % F.length("w")).cast("int")
    entries = w.select(F.col("w").alias("word"), F.concat(F.substring(F.col("w"), F.lit(1), at), F.lit("+"), F.substring(F.col("w"), at + 1, F.length("w"))).alias("variant"))
    more = spark.createDataFrame([("de-la", "de-l+a"), ("and-the", "+and-the")], "word string, variant string")
    return P.user_dictionary(_hyphened(spark, sf_dir), entries.union(more), "doc_id").withColumnRenamed("text", "stressed")


@query(rf"""
WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {_PARTS_SQL.format(r'[\p{{L}}+]+'.replace('{{', '{').replace('}}', '}'))},
b AS (SELECT * FROM ({_BENCH_SQL}) WHERE regexp_full_match(w, '\p{{L}}+') AND contains(w, 'e')),
whole AS (SELECT DISTINCT w FROM b WHERE item_id % 2 = 0 UNION SELECT 'longer'),
stems AS (SELECT DISTINCT w[1:4] AS stem FROM b WHERE item_id % 2 = 1 AND length(w) >= 4 AND contains(w[1:4], 'e')),
d AS (SELECT DISTINCT token, lower(token) AS w FROM p WHERE token <> ''),
said AS (SELECT token, w, CASE WHEN w <> 'longer' AND w IN (SELECT w FROM whole) THEN replace(w, 'e', 'ə')
                              WHEN w <> 'longer' THEN (SELECT max(replace(stem, 'e', 'ə')) || w[5:] FROM stems WHERE starts_with(w, stem)) END AS s FROM d),
m AS (SELECT token, array_to_string(list_transform(range(1, length(w) + 1), lambda k: CASE WHEN token[k] = lower(token[k]) THEN s[k] ELSE upper(s[k]) END), '') AS shown FROM said WHERE s IS NOT NULL)
SELECT doc_id, string_agg(gap || coalesce(shown, token), '' ORDER BY i) AS said FROM p LEFT JOIN m USING (token) GROUP BY doc_id
""")
def hard_vowels(spark, sf_dir):
    """The whole texts with another vowel in the words and beginnings of a list."""
    w = _bench(spark, sf_dir).where(F.col("w").contains("e"))
    whole = w.where("item_id % 2 = 0").select(F.col("w").alias("word"), F.translate("w", "e", "ə").alias("said"))
    head = F.substring("w", 1, 4)
    stems = w.where((F.col("item_id") % 2 == 1) & (F.length("w") >= 4) & head.contains("e")).select(F.concat(head, F.lit("*")).alias("word"), F.concat(F.translate(head, "e", "ə"), F.lit("*")).alias("said"))
    longer = spark.createDataFrame([("longer", "is left out")], "word string, said string")
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    return P.hard_vowels(docs, whole.union(stems).union(longer), "doc_id").withColumnRenamed("text", "said")
