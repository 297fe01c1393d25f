"""Queries of word tables: restored letters by a front-coded table, inflection both ways, list building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.regexmap import upper_letter
from ..operators import homographs as H
from ..operators import paradigm as D
from ..operators import yo as Y
from .registry import _TOK_SQL, _WORDS_SQL, _t, query

_BENCH_SQL = f"SELECT item_id, lower(unnest({_WORDS_SQL.format('text')})) AS w FROM benchmark"


def _bench(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.explode(H.words_of(F.col("text"))).alias("w")).select("item_id", F.lower("w").alias("w"))


#: Of every benchmark word with an e the first one is dotted; the item's id says whether the line is for small
#: letters only, for both, or for the capitalised word.
_DOTS_SQL = f"""
lines AS (SELECT item_id % 3 AS kind, CASE WHEN item_id % 3 = 2 THEN upper(d[1]) || d[2:] ELSE d END AS word FROM (SELECT item_id, regexp_replace(w, 'e', 'ë') AS d FROM ({_BENCH_SQL}) WHERE contains(w, 'e'))),
made AS (SELECT translate(word, 'ëË', 'eE') AS key, word, bool_or(kind <> 0 AND word[1] = lower(word[1])) AS capital FROM lines GROUP BY ALL),
best AS (SELECT key, min(word) AS word, arg_min(capital, word) AS capital FROM made GROUP BY key),
t AS {_TOK_SQL},
found AS (SELECT doc_id, tok_no, token, coalesce(a.word, CASE WHEN b.capital THEN upper(b.word[1]) || b.word[2:] END) AS restored
  FROM t LEFT JOIN best a ON a.key = token LEFT JOIN best b ON b.key = lower(token[1]) || token[2:] WHERE regexp_matches(token, '[eE]'))"""


def _dots(spark, sf_dir):
    kind = F.col("item_id") % 3
    d = F.expr("regexp_replace(w, '^([^e]*)e', '$1ë')")
    word = F.when(kind == 2, F.concat(upper_letter(F.substring(d, 1, 1)), F.substring(d, F.lit(2), F.length(d)))).otherwise(d)
    lines = _bench(spark, sf_dir).where(F.col("w").contains("e")).select(F.concat(F.when(kind == 0, "_").otherwise(""), word, F.lit("  # from the benchmark")).alias("value"))
    return Y.table(Y.entries(lines, "ëË", "eE"), "ëË")


@query(rf"""
WITH {_DOTS_SQL},
gaps AS (SELECT doc_id, generate_subscripts(g, 1) - 1 AS tok_no, unnest(g) AS gap FROM (SELECT doc_id, string_split_regex(text, '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*') AS g FROM documents WHERE text IS NOT NULL))
SELECT doc_id, string_agg(gap || coalesce(restored, t.token, ''), '' ORDER BY tok_no) AS restored
FROM gaps LEFT JOIN t USING (doc_id, tok_no) LEFT JOIN found USING (doc_id, tok_no) GROUP BY doc_id
""")
def restored_letters(spark, sf_dir):
    """The whole texts with the dots of all words in the front-coded table."""
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    return Y.restore(docs, _dots(spark, sf_dir), "doc_id", dotted="ëË", plain="eE").withColumnRenamed("text", "restored")


@query(f"WITH {_DOTS_SQL} SELECT token, restored, count(*) AS n FROM found WHERE restored IS NOT NULL GROUP BY token, restored")
def restored_words(spark, sf_dir):
    """Every different word that the table restores, with its occurrences; the table is unpacked and joined,
    as beyond the broadcast's limit."""
    tokens = _t(spark, sf_dir, "documents").select(F.explode(H.words_of(F.col("text"))).alias("token")).where(F.col("token").rlike("[eE]"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return Y.restored(counts, _dots(spark, sf_dir), dotted="ëË", plain="eE", limit=0).join(counts, "token").select("token", "restored", "n")


_CLASSES = [
    ("e", "e", "e", "nom"), ("e", "e", "es", "pl"), ("e", "e", "en", "inf"), ("e", "e", "", "short"), ("tion", "tion", "tion", "nom"), ("tion", "tion", "tional", "adj"),
    ("tion", "tion", "ting", "ger"), ("plain", "", "", "nom"), ("plain", "", "s", "gen"), ("plain", "", "er", "agent"), ("plain", "", "and", "ger"),
]
_CLASS_SQL = "classes(class, strip, add, cell) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in _CLASSES) + ")"
_LEMMA_SQL = f"""lemmas AS (SELECT DISTINCT w AS plain, CASE WHEN ends_with(w, 'tion') THEN 'tion' WHEN ends_with(w, 'e') THEN 'e' ELSE 'plain' END AS class FROM ({_BENCH_SQL}))"""


def _lemmas(spark, sf_dir):
    """Benchmark words with a stress on the first vowel, and their classes."""
    w = F.col("w")
    cls = F.when(w.endswith("tion"), "tion").when(w.endswith("e"), "e").otherwise("plain")
    return _bench(spark, sf_dir).select("w").distinct().select(F.regexp_replace("w", "^([^aeiou]*)([aeiou])", "$1+$2").alias("lemma"), cls.alias("class"))


def _classes(spark):
    return spark.createDataFrame(_CLASSES, "class string, strip string, add string, cell string")


@query(f"""
WITH {_CLASS_SQL}, {_LEMMA_SQL},
words AS (SELECT DISTINCT lower(token) AS form FROM {_TOK_SQL}),
forms AS (SELECT plain AS lemma, class, cell, plain[1:length(plain) - length(strip)] || add AS form FROM lemmas JOIN classes USING (class))
SELECT DISTINCT form, lemma, class, cell FROM forms JOIN words USING (form)
""")
def word_readings(spark, sf_dir):
    """Every reading, as lemma, class and cell, of the documents' different words, by their endings."""
    words = _t(spark, sf_dir, "documents").select(F.explode(H.words_of(F.col("text"))).alias("w")).select(F.lower("w").alias("form")).distinct()
    return D.analyse(words, _lemmas(spark, sf_dir), _classes(spark))


@query(f"""
WITH {_CLASS_SQL}, {_LEMMA_SQL},
counts AS (SELECT lower(token) AS form, count(*) AS n FROM {_TOK_SQL} GROUP BY 1),
cells AS (SELECT plain, class, plain[1:length(plain) - length(strip)] AS stem, add, length(regexp_extract(plain, '^[^aeiou]*')) AS a0,
                 regexp_matches(plain, '[aeiou]') AS has, length(regexp_extract(add, '^[^aeiou]*')) AS v FROM lemmas JOIN classes USING (class)),
forms AS (SELECT CASE WHEN has THEN plain[1:a0] || '+' || plain[a0 + 1:] ELSE plain END AS lemma, stem || add AS form,
                 CASE WHEN NOT has THEN stem || add WHEN a0 < length(stem) THEN stem[1:a0] || '+' || (stem || add)[a0 + 1:]
                      WHEN v < length(add) THEN stem || add[1:v] || '+' || add[v + 1:] ELSE stem || add END AS stressed FROM cells),
f AS (SELECT lemma, form, min(stressed) AS stressed FROM forms GROUP BY lemma, form),
c AS (SELECT *, sum(n) OVER (PARTITION BY lemma)::BIGINT AS lemma_n FROM f JOIN counts USING (form)),
k AS (SELECT * FROM c WHERE lemma_n >= 20 AND n >= 3
  AND form NOT IN (SELECT w FROM ({_BENCH_SQL}) WHERE item_id % 7 = 0)
  AND form NOT IN (SELECT lower(unnest({_WORDS_SQL.format('text')})) FROM conversations WHERE role = 'user')
  AND form NOT IN (SELECT lower(unnest({_WORDS_SQL.format('p_name')})) FROM part))
SELECT lemma, form, stressed, n, lemma_n FROM k WHERE form NOT IN (SELECT form FROM k GROUP BY form HAVING count(DISTINCT stressed) > 1)
""")
def list_candidates(spark, sf_dir):
    """Forms of frequent lemmas with their stress and counts over the documents, less three known lists."""
    words = lambda df, column: df.select(F.explode(H.words_of(F.col(column))).alias("w")).select(F.lower("w").alias("word"))
    counts = words(_t(spark, sf_dir, "documents"), "text").groupBy("word").agg(F.count("*").alias("n"))
    known = [
        _bench(spark, sf_dir).where("item_id % 7 = 0").select(F.col("w").alias("word")),
        words(_t(spark, sf_dir, "conversations").where("role = 'user'"), "text"),
        words(_t(spark, sf_dir, "part"), "p_name"),
    ]
    return D.candidates(_lemmas(spark, sf_dir), _classes(spark), counts, known, 20, 3, "aeiou")
