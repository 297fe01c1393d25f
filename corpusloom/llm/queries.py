"""One query for each operator, over its whole table, in the form that the contract asks for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, lexsearch, neardup, quality, resample, ruleclf, sharding, suffixdedup, tokencount, tokenout, urlfilter
from .common import bound_batches, in_learning_part, table


def _held_out() -> Column:
    """A row without an id isn't learned from, and isn't of the held-out part."""
    return F.coalesce(~in_learning_part(F.col("doc_id")), F.lit(False)).alias("held_out")


#: The fixed rules of the URL query.
URL_RULES = [
    urlfilter.Rule("com", "/", "allow"),
    urlfilter.Rule("example.com", "/en/", "block"),
    urlfilter.Rule("www.example.com", "/en/", "allow"),
    urlfilter.Rule("net", "/es/", "block"),
    urlfilter.Rule("net", "/fr/", "block"),
]


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "url_verdict.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality.judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    out = v.select("doc_id", "quality_verdict.*")
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), docs.where(in_learning_part(F.col("doc_id"))))
    p = F.col("language")
    return out.select("doc_id", _held_out(), p["lang"].alias("lang_pred"), p["score"].alias("score"), p["rejected"].alias("rejected"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenout.scratch_path(spark)
    tokenout.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    return tokenout.positions(spark, path)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    t = bpe.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    out = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return out.select("doc_id", F.col("t.n_tokens").alias("n_tokens"), F.sha2("t.ids", 256).alias("ids_sha256"), F.sha2(F.col("t.decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    n = tokencount.token_count(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ruleclf.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", _held_out(), F.col("quality_score").alias("score"), F.col("quality_good").cast("int").alias("predicted"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard": op1_shard,
    "op2_url_filter": op2_url_filter,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_language": op5_language,
    "op6_token_files": op6_token_files,
    "op7_bpe": op7_bpe,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_counts": op9_token_counts,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_resample": op11_resample,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_ranked_search": op13_ranked_search,
}

_FOUND = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')"

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": rf"""
WITH p AS (
  SELECT page_id,
         translate({_FOUND}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
""",
    "op4_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT k, lang, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
g AS (SELECT k, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g WHERE g IS NOT NULL),
covered AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM again WHERE n > 1) GROUP BY k),
base AS (
  SELECT w.k, doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         list_transform(['[a-z]', '[A-Z]', '[0-9]', '[#*$%&|<>]', '[\x20\x09-\x0D]', '[.,;:!?]', '[\x00-\x08\x0E-\x1F\x22\x27-\x29+\-/=@\[-`{}~\x7F]', '[^\x00-\x7F]'],
                        lambda c: length(text) - length(regexp_replace(text, c, '', 'g'))) AS classes
  FROM w LEFT JOIN covered ON covered.k = w.k),
langs AS (SELECT lang, sum(n_words) AS n FROM base WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 1000),
class_sums AS (SELECT lang, c, sum(x)::DOUBLE AS n FROM (SELECT lang, generate_subscripts(classes, 1) AS c, unnest(classes) AS x FROM base) JOIN langs USING (lang) GROUP BY lang, c),
class_ref AS (SELECT lang, c, s.n / sum(s.n) OVER (PARTITION BY lang) AS r FROM class_sums s),
counts AS (SELECT lang, word, count(*) AS c FROM u WHERE lang IS NOT NULL GROUP BY lang, word),
word_ref AS (SELECT lang, word, c / n::DOUBLE AS r FROM (SELECT lang, word, c, n, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS place FROM counts JOIN langs USING (lang) WHERE c >= 0.002 * n) WHERE place <= 40),
own AS (SELECT k, word, count(*) AS c FROM u WHERE word IN (SELECT word FROM word_ref) GROUP BY k, word),
pc AS (SELECT b.k, r.lang, b.classes[r.c] / greatest(list_sum(b.classes), 1)::DOUBLE AS p, r.r FROM base b CROSS JOIN class_ref r WHERE n_words > 0),
pw0 AS (SELECT b.k, r.lang, coalesce(o.c, 0) / greatest(b.n_words, 1)::DOUBLE AS p, r.r FROM base b CROSS JOIN word_ref r LEFT JOIN own o ON o.k = b.k AND o.word = r.word WHERE n_words > 0),
pw AS (SELECT * FROM pw0 UNION ALL SELECT k, l.lang, 1 - coalesce(p, 0), 1 - coalesce(r, 0) FROM (SELECT DISTINCT k FROM base WHERE n_words > 0) CROSS JOIN langs l LEFT JOIN (SELECT k, lang, sum(p) AS p, sum(r) AS r FROM pw0 GROUP BY k, lang) s USING (k, lang)),
jc AS (SELECT k, lang, sqrt(least(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + r) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((p + r) / 2)) ELSE 0 END) / 2, 0), 1)) AS dc FROM pc GROUP BY k, lang),
jw AS (SELECT k, lang, sqrt(least(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + r) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((p + r) / 2)) ELSE 0 END) / 2, 0), 1)) AS dw FROM pw GROUP BY k, lang),
best AS (SELECT k, arg_min(dc, (dc + dw, lang)) AS dc, arg_min(dw, (dc + dw, lang)) AS dw FROM jc JOIN jw USING (k, lang) GROUP BY k),
v AS (SELECT base.*, coalesce(dc, 0) AS dc, coalesce(dw, 0) AS dw, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM base LEFT JOIN best USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(dc, 6) AS class_distance, round(dw, 6) AS word_distance, failed AS base_failed,
       NOT failed AND dc <= 0.175 + 0.6 / sqrt(greatest(n_words, 1)) AND dw <= 0.38 AS kept
FROM v
""",
    "op8_near_duplicates": r"""
WITH RECURSIVE n AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM n),
s AS (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
c AS (SELECT id, array_to_string(ws[i:i + 4], ' ') AS shingle, count(*) AS c FROM s GROUP BY ALL),
t AS (SELECT id, sum(c) AS total FROM c GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS common FROM c a JOIN c b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE common >= 0.8 * (x.total + y.total - common)),
sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, r) AS (SELECT id, id FROM n UNION SELECT reach.id, sides.b FROM reach JOIN sides ON reach.r = sides.a),
classes AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM documents LEFT JOIN n USING (text) LEFT JOIN classes USING (id)
""",
    "op11_resample": r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
f AS (SELECT k, word, count(*) AS c FROM (SELECT k, unnest(ws) AS word FROM w) GROUP BY ALL),
b AS (
  SELECT word, count(*) AS t FROM (
    SELECT translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM benchmark)
  GROUP BY word),
own AS (SELECT word, sum(c) AS s FROM f GROUP BY word),
words AS (SELECT word, coalesce(s, 0)::BIGINT AS s, coalesce(t, 0)::BIGINT AS t, hex(encode(word)) AS x FROM own FULL JOIN b USING (word)),
hashed AS (
  SELECT word, s, t, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: list_reduce(list_prepend(xor(c, y), range(0, 8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) % 10000 AS bucket
  FROM words),
sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((sums.t + 1)::DOUBLE * (total.s + 10000)::DOUBLE / ((sums.s + 1)::DOUBLE * (total.t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, total),
weights AS (SELECT k, sum(c)::BIGINT AS n, sum(c * gain)::BIGINT AS weight FROM f JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY k),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (k)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20 AND doc_id IS NOT NULL) OVER () AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND doc_id IS NOT NULL AND place <= many * 10 // 100 THEN place END AS rank FROM ranked
""",
    "op12_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT k, doc_id, c, substr(x, 2 * c + 1, 610) AS y FROM (SELECT k, doc_id, x, unnest(range(0, length(x) // 2 - 49, 256)) AS c FROM d WHERE doc_id IS NOT NULL AND length(x) >= 100)),
w AS (SELECT k, doc_id, c + j AS i, substr(y, 2 * j + 1, 100) AS s FROM (SELECT k, doc_id, c, y, unnest(range(0, length(y) // 2 - 49)) AS j FROM p)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM w JOIN f USING (s) WHERE doc_id > least),
n AS (SELECT k, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS run FROM g),
spans AS (SELECT k, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY k, run),
gaps AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS c FROM spans),
cut AS (
  SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM gaps JOIN d USING (k) GROUP BY k)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (k)
""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
total AS (SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
items AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
q AS (
  SELECT DISTINCT q, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM items),
p AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
m AS (SELECT k, doc_id, 10 + ((90 * len(ws)::BIGINT * n) // l) AS m FROM d, total WHERE len(ws) > 0),
s AS (SELECT q, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (k) GROUP BY q, k),
r AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (k) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r JOIN items USING (q) WHERE rank <= 10
""",
}
