"""Queries of list building, predicates and relational forms over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import marks as M
from ..operators import segment as S
from ..operators import survey as V
from .registry import _TOK_SQL, _t, _tokens, query


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, (count(*) FILTER (NOT regexp_matches(line, '[\p{L}\p{N}]')))::BIGINT AS noise,
       (count(*) FILTER (regexp_matches(line, '[0-9A-Za-z#$%&*+/<=>@^_|~№§°\x{2000}-\x{2BFF}\x{10000}-\x{10FFFF}]')))::BIGINT AS grow FROM l GROUP BY doc_id
""")
def line_predicates(spark, sf_dir):
    """Lines of every document: how many have nothing to say, how many may grow when spoken."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(M.is_noise(F.col("line"))).alias("noise"), F.count_if(M.may_grow(F.col("line"))).alias("grow"))


@query(r"SELECT page_id, coalesce(regexp_matches(html, '^\s*<(speak|\?xml)', 'i'), false) AS markup FROM pages")
def speech_markup_pages(spark, sf_dir):
    """Pages that are speech markup documents."""
    return _t(spark, sf_dir, "pages").select("page_id", F.coalesce(M.is_ssml(F.col("html")), F.lit(False)).alias("markup"))


@query(f"""
WITH listed AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))) AS word FROM benchmark)
SELECT word, count(*) AS n FROM (SELECT lower(token) AS word FROM {_TOK_SQL}) SEMI JOIN listed USING (word) GROUP BY word
""")
def listed_form_counts(spark, sf_dir):
    """Occurrences of the benchmark's words in all documents."""
    listed = _t(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)).alias("word"))
    return V.counts_of_listed(_tokens(spark, sf_dir).select(F.lower("token").alias("word")), listed, "word")


@query(f"""
WITH b AS (SELECT lower(token) AS word, regexp_matches(lead(token) OVER (PARTITION BY doc_id ORDER BY tok_no), '^[A-Z]') AS up FROM {_TOK_SQL}),
     c AS (SELECT word, count(*) FILTER (up) AS n_left, count(*) FILTER (NOT up) AS n_right FROM b WHERE up IS NOT NULL GROUP BY word)
SELECT * FROM c WHERE n_left + n_right >= 20 AND greatest(n_left, n_right) >= 0.95 * (n_left + n_right)
""")
def context_majorities(spark, sf_dir):
    """Words after which a capital is decided: at least 20 contexts, 95 of 100 alike."""
    words = F.regexp_extract_all("text", F.lit(S.WORD), F.lit(0))
    docs = _t(spark, sf_dir, "documents").select(words.alias("w")).where(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(F.lower(a).alias("word"), b.rlike("^[A-Z]").alias("up")))
    rows = docs.select(F.explode(pairs).alias("p")).select("p.*")
    return V.context_stats(rows, ["word"], F.col("up"), ~F.col("up"), 20, 0.95)


@query("SELECT l_partkey AS form, min(l_linestatus) AS variant FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY l_partkey HAVING count(DISTINCT l_linestatus) = 1")
def forms_of_one_variant(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("form"), F.col("l_linestatus").alias("variant"))
    return V.single_variant(rows, "form", "variant")


@query("""
WITH p AS (SELECT p_brand AS word, p_type AS phrase, (min(p_size) % 2)::VARCHAR AS variant FROM part GROUP BY ALL UNION SELECT DISTINCT p_brand, substr(p_type, 1, 4), '0' FROM part)
SELECT a.word, a.phrase, a.variant, count(b.phrase) AS conflicts FROM p a LEFT JOIN p b ON a.word = b.word AND a.phrase <> b.phrase AND contains(b.phrase, a.phrase) AND a.variant <> b.variant GROUP BY ALL
""")
def phrase_conflicts(spark, sf_dir):
    """Phrases contained in others of their word with another variant."""
    part = _t(spark, sf_dir, "part")
    long = part.groupBy(F.col("p_brand").alias("word"), F.col("p_type").alias("phrase")).agg((F.min("p_size") % 2).cast("string").alias("variant"))
    short = part.select(F.col("p_brand").alias("word"), F.substring("p_type", 1, 4).alias("phrase"), F.lit("0").alias("variant"))
    return V.conflicts(long.union(short).distinct(), "word", "phrase", "variant")


@query("""
SELECT lang, count(*) AS n, count_if(quality = 1) AS n_without, count_if(toxic = 0) AS n_with, count_if(toxic = 0) - count_if(quality = 1) AS lift
FROM documents JOIN labels USING (doc_id) GROUP BY lang
""")
def lift_by_lang(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    return V.lift(rows, ["lang"], F.col("quality") == 1, F.col("toxic") == 0)


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '5%' AND o_custkey IS NOT NULL)
""")
def candidate_sieve(spark, sf_dir):
    """Rows whose key one list holds and another doesn't."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return V.sieve(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders.where("o_orderpriority like '1%'"), orders.where("o_orderpriority like '5%'"), "c_custkey")


@query("""
SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1
""")
def first_events(spark, sf_dir):
    """The first event of each user and type."""
    rows = _t(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "ts", F.struct("event_type", "user_id").alias("k"))
    return V.first_of_each(rows, "k", "ts", "event_id").select("event_type", "event_id", "user_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def latest_events(spark, sf_dir):
    """A report of the 2,000 latest events."""
    return V.latest(_t(spark, sf_dir, "events"), ["ts", "event_id"], 2000).select("event_id", "event_type")


@query("""
WITH h AS (SELECT source, doc_id, md5(doc_id::VARCHAR) AS h FROM documents), few AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM h)
SELECT source, doc_id FROM few WHERE r <= 20 ORDER BY reverse(h), doc_id LIMIT 50
""")
def capped_and_shuffled(spark, sf_dir):
    """At most 20 documents of each source, shuffled, cut to 50 (the sampler)."""
    return V.capped_per_group(_t(spark, sf_dir, "documents").select("source", "doc_id"), "source", 20, 50, "doc_id")


@query("""
WITH a AS (SELECT l_partkey AS form, bit_or(1 << (l_linenumber - 1)) AS tags FROM lineitem GROUP BY l_partkey, l_returnflag), f AS (SELECT p_partkey AS form, 1 + 2 * (p_size % 2) AS features FROM part)
SELECT form, features, min(tags)::BIGINT AS tags FROM a JOIN f USING (form) WHERE tags & features = features GROUP BY ALL HAVING count(*) = 1
""")
def compatible_readings(spark, sf_dir):
    """Readings (tags) of a form that hold the features asked for, where only one does."""
    tags = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("form"), "l_returnflag").agg(F.bit_or(F.expr("shiftleft(1L, cast(l_linenumber - 1 as int))")).alias("tags"))
    asked = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("form"), (1 + 2 * (F.col("p_size") % 2)).cast("long").alias("features"))
    return V.compatible(tags.drop("l_returnflag"), asked, "form", "tags", "features")


@query("""
WITH r AS (SELECT s_suppkey, s_suppkey * 10 AS low, s_suppkey * 10 + 25 AS high FROM supplier)
SELECT s_suppkey, count(*) AS n, sum(p_size)::BIGINT AS total FROM part JOIN r ON p_partkey >= low AND p_partkey < high GROUP BY s_suppkey
""")
def range_join(spark, sf_dir):
    """Rows joined to the ranges that hold their key, by buckets."""
    ranges = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 10).alias("low"), (F.col("s_suppkey") * 10 + 25).alias("high"))
    hits = V.in_range(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), ranges, "p_partkey", "low", "high", 32)
    return hits.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total"))


@query("""
SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def cube_counts(spark, sf_dir):
    out = _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@query("""
SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())
""")
def grouping_set_counts(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    out = docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n")


@query(None)
def approximate_words(spark, sf_dir):
    """Distinct words and the median length of a word by language, approximately."""
    t = _tokens(spark, sf_dir)
    return t.groupBy("lang").agg(F.approx_count_distinct(F.lower("token"), 0.02).alias("words"), F.percentile_approx(F.length("token"), 0.5, 10_000).alias("median_length"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_nations(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("""
SELECT kind, nation, count(*) AS n, round(sum(balance), 2) AS total FROM (SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, NULL FROM supplier) GROUP BY ALL
""")
def united_parties(spark, sf_dir):
    """Two lists of other columns under one head."""
    customers = _t(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    both = customers.unionByName(suppliers, allowMissingColumns=True)
    return both.groupBy("kind", "nation").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("total"))


@query("""
WITH m AS (SELECT label, avg(embedding[1]::DOUBLE) AS own FROM embeddings GROUP BY label), a AS (SELECT avg(embedding[1]::DOUBLE) AS level FROM embeddings)
SELECT label, round(CASE WHEN own <= 0 OR level <= 0 THEN 1 ELSE greatest(0.5, least(2, level / own)) END, 6) AS gain FROM m, a
""")
def loudness_gains(spark, sf_dir):
    """The gain of each group to the level of all, between a half and two."""
    x = _t(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"))
    level = x.agg(F.avg("x")).first()[0] or 0.0  # one number
    return x.groupBy("label").agg(F.avg("x").alias("own")).select("label", F.round(M.loudness_match(F.lit(float(level)), F.col("own")), 6).alias("gain"))


@query("""
WITH s AS (SELECT conv_id, turn, string_split(text, '. ') AS ss FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, list_sum(list_transform(ss, lambda s: length(s)))::BIGINT AS symbols, list_sum(list_transform(ss, lambda s: CASE WHEN ends_with(s, '?') THEN length(s) ELSE 0 END))::BIGINT AS asked FROM s
""")
def types_per_symbol(spark, sf_dir):
    """Sentences of every turn with a type for each symbol (1: question), counted."""
    s = _t(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.split("text", r"\. ", -1).alias("ss"))
    ids = M.type_per_symbol(F.col("ss"), F.transform("ss", lambda x: x.endswith("?").cast("int")))
    return s.select("conv_id", "turn", F.size(ids).cast("long").alias("symbols"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, b: a + b).alias("asked"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '^\s*([\p{L}\p{N}''’-]+[\s,]*){1,4}!+\s*$') THEN regexp_replace(text, '([\p{L}\p{N}''’-]+)(!+\s*)$', '*\1*\2') ELSE text END AS text
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+!+')) AS text FROM documents)
""")
def exclamation_focus(spark, sf_dir):
    """Every exclamation of every document with its focus marked where it is short."""
    # every stretch without a stop, and of these the ones with a mark: else one without would be tried from each character
    s = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]++!*+"), F.lit(0))).alias("text")).where(F.col("text").endswith("!"))
    return s.select("doc_id", M.exclamation_focus(F.col("text")).alias("text"))


@query("""
SELECT o_orderkey, CASE WHEN k BETWEEN 1 AND length(w) THEN substr(w, 1, length(w) - k) || '+' || substr(w, length(w) - k + 1) ELSE w END AS said
FROM (SELECT o_orderkey, lower(o_orderpriority) AS w, (o_custkey % 12)::INTEGER AS k FROM orders)
""")
def marks_from_the_end(spark, sf_dir):
    """A mark placed by its distance from a word's end."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("w"), (F.col("o_custkey") % 12).cast("int").alias("k"))
    return rows.select("o_orderkey", M.stress_from_end(F.col("w"), F.col("k")).alias("said"))


@query("""
SELECT event_id, repeat(' ', 6 + length(n) + 2) || 'x' || repeat(' ', 6) AS text FROM (SELECT event_id, (event_id % 1000)::VARCHAR AS n FROM events)
""")
def blanked_markers(spark, sf_dir):
    """Control markers of a rendered line as blanks of their length."""
    line = F.concat(F.lit("{pause:"), (F.col("event_id") % 1000).cast("string"), F.lit("}x{skip}"))
    return _t(spark, sf_dir, "events").select("event_id", M.blanked_markers(line).alias("text"))
