"""All queries of the engine over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions import rules as R
from ..functions import slavic as V
from ..operators import corpus as C
from ..operators import lexicon as L
from ..operators import pcm as P
from ..operators import segment as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_WORDS_SQL = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*')"
_PARS_SQL = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n+'), lambda p: trim(p, ' ')), lambda p: p <> '')"


@query(f"""
WITH p AS (SELECT doc_id, lang, unnest({_PARS_SQL}) AS par FROM documents),
     c AS (SELECT lang, len({_WORDS_SQL.format('par')}) AS words, len(regexp_extract_all(par, '[.!?…]+(\\s|$)')) AS stops FROM p)
SELECT lang, count(*) AS n_paragraphs, sum(stops)::BIGINT AS n_stops, sum(words)::BIGINT AS n_words FROM c GROUP BY lang
""")
def segment_counts_by_lang(spark, sf_dir):
    """Paragraphs, sentence ends and words by language."""
    par = S.paragraphs(_t(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    words = F.size(F.regexp_extract_all("paragraph", F.lit(S.WORD), F.lit(0)))
    stops = F.size(F.regexp_extract_all("paragraph", F.lit(r"[.!?…]+(\s|$)"), F.lit(0)))
    return par.groupBy("lang").agg(F.count("*").alias("n_paragraphs"), F.sum(stops).alias("n_stops"), F.sum(words).alias("n_words"))


@query(f"SELECT doc_id, generate_subscripts(ps, 1) - 1 AS par_no, unnest(ps) AS paragraph FROM (SELECT doc_id, {_PARS_SQL} AS ps FROM documents)")
def paragraph_split(spark, sf_dir):
    return S.paragraphs(_t(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""
WITH p AS (SELECT unnest({_PARS_SQL}) AS par FROM documents),
     s AS (SELECT unnest(list_filter(string_split(regexp_replace(par, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS s FROM p),
     n AS (SELECT least(len({_WORDS_SQL.format('s')}) // 5 * 5, 100) AS bucket FROM s)
SELECT bucket::BIGINT AS bucket, count(*) AS n_sentences FROM n GROUP BY bucket
""")
def sentence_length_histogram(spark, sf_dir):
    """Sentences by length in words (buckets of five); plain sentence split."""
    par = S.paragraphs(_t(spark, sf_dir, "documents").select("text"))
    sent = par.select(F.explode(F.filter(F.split("paragraph", r"(?<=[.!?…])\s+"), lambda s: F.trim(s) != "")).alias("s"))
    words = F.size(F.regexp_extract_all("s", F.lit(S.WORD), F.lit(0)))
    return sent.groupBy(F.least(F.floor(words / 5) * 5, F.lit(100)).cast("long").alias("bucket")).agg(F.count("*").alias("n_sentences"))


def _tokens(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return docs.select("doc_id", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(S.WORD), F.lit(0))).alias("tok_no", "token"))


_TOK_SQL = f"(SELECT doc_id, lang, generate_subscripts(ts, 1) - 1 AS tok_no, unnest(ts) AS token FROM (SELECT doc_id, lang, {_WORDS_SQL.format('text')} AS ts FROM documents))"


@query(f"""
WITH c AS (SELECT lang, lower(token) AS word, count(*) AS n FROM {_TOK_SQL} GROUP BY ALL)
SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 20
""")
def top_words_by_lang(spark, sf_dir):
    counts = _tokens(spark, sf_dir).groupBy("lang", F.lower("token").alias("word")).agg(F.count("*").alias("n"))
    return C.top_per_group(counts, "lang", [F.desc("n"), F.col("word")], 20)


@query(f"""
WITH b AS (SELECT lang, lower(token) AS a, lower(lead(token) OVER (PARTITION BY doc_id ORDER BY tok_no)) AS b FROM {_TOK_SQL})
SELECT lang, a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 20
""")
def frequent_bigrams(spark, sf_dir):
    """Adjacent words within a document that occur at least 20 times; pairs are made per row."""
    words = F.transform(F.regexp_extract_all("text", F.lit(S.WORD), F.lit(0)), F.lower)
    docs = _t(spark, sf_dir, "documents").select("lang", words.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return docs.where(F.size("w") > 1).select("lang", F.explode(pairs).alias("p")).groupBy("lang", "p.a", "p.b").agg(F.count("*").alias("n")).where("n >= 20")


@query(f"""
WITH t AS (SELECT doc_id, tok_no, token, lag(token) OVER w AS l, lead(token) OVER w AS r FROM {_TOK_SQL} WINDOW w AS (PARTITION BY doc_id ORDER BY tok_no)),
     c AS (SELECT * FROM t WHERE lower(token) IN ('with', 'nicht', 'dans'))
SELECT doc_id, tok_no, side, phrase FROM (
  SELECT doc_id, tok_no, 'left' AS side, concat_ws(' ', l, token) AS phrase FROM c UNION ALL
  SELECT doc_id, tok_no, 'right', concat_ws(' ', token, r) FROM c UNION ALL
  SELECT doc_id, tok_no, 'both', concat_ws(' ', l, token, r) FROM c)
""")
def concordance(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(S.WORD), F.lit(0))
    return C.contexts_in_texts(_t(spark, sf_dir, "documents"), ["doc_id"], words, ["with", "nicht", "dans"])


@query(f"""
WITH c AS (SELECT lower(token) AS key, token AS variant, count(*) AS n FROM {_TOK_SQL} GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, variant) AS k, sum(n) OVER (PARTITION BY key)::BIGINT AS total FROM c)
SELECT key, variant, n, total FROM r WHERE k = 1 AND total >= 50 AND n >= 0.75 * total
""")
def case_variant_majority(spark, sf_dir):
    """The dominant spelling of each word: at least 50 occurrences and a share of 0.75."""
    t = _tokens(spark, sf_dir)
    return C.shared_majority(C.variant_counts(t, F.lower("token"), F.col("token")), 50, 0.75)


@query(f"""
WITH t AS (SELECT doc_id, tok_no, token FROM {_TOK_SQL}),
     n AS (SELECT lower(token) AS word, doc_id, tok_no, token FROM t WHERE regexp_full_match(token, '[A-Z][a-z]{{2,}}') AND tok_no > 0),
     known AS (SELECT DISTINCT lower(unnest({_WORDS_SQL.format('text')})) AS word FROM benchmark)
SELECT word, arg_min(token, doc_id * 1000000 + tok_no) AS first_token, count(*) AS n FROM n ANTI JOIN known USING (word) GROUP BY word HAVING count(*) >= 5
""")
def name_candidates(spark, sf_dir):
    """Capitalised words, not first in their text, that no known list holds: occurrences and the
    first one's spelling."""
    t = _tokens(spark, sf_dir).where(F.col("token").rlike("^[A-Z][a-z]{2,}$") & (F.col("tok_no") > 0)).withColumn("word", F.lower("token"))
    known = _t(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.regexp_extract_all("text", F.lit(S.WORD), F.lit(0)), F.lower)).alias("word")).distinct()
    new = t.join(known, "word", "left_anti")
    return C.first_and_count(new, "word", F.col("doc_id") * 1000000 + F.col("tok_no"), ["token"]).where("n >= 5")


@query(f"""
WITH w AS (SELECT DISTINCT item_id, lower(unnest({_WORDS_SQL.format('text')})) AS word FROM benchmark),
     d AS (SELECT lower(token) AS word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {_TOK_SQL} GROUP BY ALL)
SELECT item_id, count(*) AS words, sum(coalesce(n, 0))::BIGINT AS seen, min(coalesce(docs, 0))::BIGINT AS rarest FROM w LEFT JOIN d USING (word) GROUP BY item_id
""")
def dictionary_coverage(spark, sf_dir):
    """Benchmark words looked up in the corpus' word table."""
    w = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(S.WORD), F.lit(0)), F.lower))).alias("word"))
    t = L.with_dimension(_tokens(spark, sf_dir).select(F.lower("token").alias("word"), "doc_id"), w.select("word").distinct(), "word", "left_semi")
    d = t.groupBy("word", "doc_id").agg(F.count("*").alias("k")).groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))
    out = w.join(d, "word", "left").groupBy("item_id")
    return out.agg(F.count("*").alias("words"), F.sum(F.coalesce("n", F.lit(0))).alias("seen"), F.min(F.coalesce("docs", F.lit(0))).alias("rarest"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\.{3,}', '…', 'g'), '!+', '!', 'g'), '\\?+', '?', 'g') AS text FROM documents WHERE regexp_matches(text, '\\.{3,}|!{2,}|\\?{2,}')")
def repeated_marks(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where(F.col("text").rlike(r"\.{3,}|!{2,}|\?{2,}"))
    return docs.select("doc_id", F.regexp_replace(F.regexp_replace("text", r"\.{3,}", "…"), r"([!?])\1+", "$1").alias("text"))


@query("""
SELECT coalesce(lang, 'all') AS lang, coalesce(quality, -1) AS quality, n, n_right, share FROM (
  SELECT lang, quality, count(*) AS n, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS n_right, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS share
  FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, quality))
""")
def accuracy_rollup(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    out = C.accuracy(rows, F.col("toxic") == 0, "lang", "quality")
    return out.withColumns({"lang": F.coalesce("lang", F.lit("all")), "quality": F.coalesce("quality", F.lit(-1))})


@query("""
SELECT source, doc_id, n_chars, running FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 20000
""")
def byte_budget(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return C.within_budget(rows, ["source"], [F.desc("doc_id")], "n_chars", 20000)


@query("""
SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id % 97, doc_id) AS rank FROM documents) WHERE rank <= 25
""")
def capped_sample(spark, sf_dir):
    """At most 25 documents of each language in a fixed pseudo-random order (the sampler)."""
    rows = _t(spark, sf_dir, "documents").select("lang", "doc_id")
    return C.top_per_group(rows, "lang", [F.col("doc_id") % 97, F.col("doc_id")], 25)


@query("""
WITH l AS (SELECT lower(substr(p_name, 1, 4)) AS key, p_partkey AS line_no, p_size AS priority, p_brand AS variant FROM part)
SELECT key, priority, line_no, variant FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority DESC, line_no DESC) AS r FROM l) WHERE r = 1
""")
def dictionary_merge(spark, sf_dir):
    """Of equal keys the row of the highest priority and last line wins."""
    lines = _t(spark, sf_dir, "part").select(F.lower(F.substring("p_name", 1, 4)).alias("key"), F.col("p_partkey").alias("line_no"), F.col("p_size").alias("priority"), F.col("p_brand").alias("variant"))
    return C.last_line_wins(lines, "key", "priority", "line_no").select("key", "priority", "line_no", "variant")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def key_difference(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).where("c_custkey is not null")
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@query("""
SELECT l_returnflag AS form, bit_or(1 << (l_linenumber - 1))::BIGINT AS tags, list_sort(list(DISTINCT l_linestatus)) AS variants FROM lineitem GROUP BY l_returnflag
""")
def tag_union(spark, sf_dir):
    """Tags of all readings of a form OR-ed, and its set of variants."""
    rows = _t(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("form")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(l_linenumber - 1 as int))")).alias("tags"), F.array_sort(F.collect_set("l_linestatus")).alias("variants")
    )


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _under_1000_sql(n: str, case: str, gender: str) -> str:
    u, t, h = N.unit_words(case, gender), N.ten_words(case), N.hundred_words(case)
    rest = f"(({n}) % 100)"
    return (
        f"concat_ws(' ', nullif({_list(h)}[({n}) // 100 + 1], ''), "
        f"CASE WHEN {rest} < 20 THEN nullif({_list(u)}[{rest} + 1], '') ELSE concat_ws(' ', {_list(t)}[{rest} // 10 + 1], nullif({_list(u)}[{rest} % 10 + 1], '')) END)"
    )


def _plural_sql(n: str, one: str, few: str, many: str) -> str:
    return f"CASE WHEN ({n}) % 100 BETWEEN 11 AND 19 THEN '{many}' WHEN ({n}) % 10 = 1 THEN '{one}' WHEN ({n}) % 10 BETWEEN 2 AND 4 THEN '{few}' ELSE '{many}' END"


def _cardinal_sql(n: str, gender: str = "m") -> str:
    """Below a million, nominative."""
    high = f"nullif(({n}) // 1000, 0)"
    thousand = f"CASE WHEN ({n}) >= 1000 THEN {_under_1000_sql(high, 'nom', 'f')} || ' ' || {_plural_sql(high, 'тысяча', 'тысячи', 'тысяч')} END"
    return f"CASE WHEN ({n}) = 0 THEN 'ноль' ELSE concat_ws(' ', {thousand}, nullif({_under_1000_sql(f'({n}) % 1000', 'nom', gender)}, '')) END"


@query(f"""
SELECT l_orderkey, l_linenumber, {_cardinal_sql('n')} || ' ' || {_plural_sql('n', 'штука', 'штуки', 'штук')} AS said
FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS n FROM lineitem)
""")
def quantity_words(spark, sf_dir):
    """Quantities in words with the noun's agreeing form."""
    n = F.col("l_quantity").cast("long")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", N.cardinal(n), N.plural(n, "штука", "штуки", "штук")).alias("said"))


@query(f"""
SELECT p_partkey, {_cardinal_sql('c // 100')} || ' ' || {_plural_sql('c // 100', 'рубль', 'рубля', 'рублей')} || ' ' || {_cardinal_sql('c % 100', 'f')} || ' ' || {_plural_sql('c % 100', 'копейка', 'копейки', 'копеек')} AS said
FROM (SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS c FROM part)
""")
def price_words(spark, sf_dir):
    """Prices as rubles and kopecks in words; rounded to whole kopecks once."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return _t(spark, sf_dir, "part").select("p_partkey", N.money_words(cents, ("рубль", "рубля", "рублей"), ("копейка", "копейки", "копеек")).alias("said"))


_DAYS = [N.ordinal_words(d, "gen", "n") if d <= 20 or d == 30 else ("двадцать " if d < 30 else "тридцать ") + N.ordinal_words(d % 10, "gen", "n") for d in range(1, 32)]


@query(f"SELECT o_orderkey, {_list(_DAYS)}[day(o_orderdate)] || ' ' || {_list(N.MONTHS_GEN)}[month(o_orderdate)] AS said FROM orders")
def order_day_words(spark, sf_dir):
    """Rendered as dd.mm.yyyy, read back by the date rule, without the year."""
    shown = F.date_format("o_orderdate", "dd.MM.yyyy")
    said = R.dates(shown)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(said, r"^(.*? (?:" + "|".join(N.MONTHS_GEN) + "))", 1).alias("said"))


@query(f"""
SELECT event_id, {_cardinal_sql('h')} || ' ' || {_plural_sql('h', 'час', 'часа', 'часов')} || ' ' || {_cardinal_sql('m', 'f')} || ' ' || {_plural_sql('m', 'минута', 'минуты', 'минут')} AS said
FROM (SELECT event_id, hour(ts) AS h, minute(ts) AS m FROM events)
""")
def event_time_words(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", R.times(F.date_format("ts", "HH:mm")).alias("said"))


@query(None)
def normalise_documents(spark, sf_dir):
    """The whole chain over every document."""
    return R.normalise(_t(spark, sf_dir, "documents").select("doc_id", "text"))


@query(None)
def normalise_pages(spark, sf_dir):
    """The whole chain over the readable text of every page."""
    return R.normalise(_t(spark, sf_dir, "pages").select("page_id", R.strip_markup(F.col("html")).alias("text")))


_YEARS = "[" + ", ".join(f"'{N.ordinal_words(y, 'gen', 'm')}'" for y in range(1, 20)) + "]"
_TENS = "[" + ", ".join(f"'{N.ordinal_words(y, 'gen', 'm')}'" for y in range(10, 100, 10)) + "]"
#: The years 1901 to 2099 as genitive ordinals.
_YEAR_SQL = f"""CASE WHEN y = 2000 THEN 'двухтысячного' ELSE CASE WHEN y < 2000 THEN 'тысяча девятьсот ' ELSE 'две тысячи ' END || CASE WHEN y % 100 < 20 THEN {_YEARS}[y % 100] WHEN y % 10 = 0 THEN {_TENS}[y % 100 // 10]
  ELSE {_list(N.ten_words('nom'))}[y % 100 // 10 + 1] || ' ' || {_YEARS}[y % 10] END END"""


@query(f"""
SELECT 'lineitem' AS source, l_orderkey * 10 + l_linenumber AS key, {_cardinal_sql('n')} || ' ' || {_plural_sql('n', 'километр', 'километра', 'километров')} || ', ' || {_cardinal_sql('d')} || ' ' || {_plural_sql('d', 'процент', 'процента', 'процентов')} AS text
FROM (SELECT *, l_quantity::BIGINT AS n, round(l_discount * 100)::BIGINT AS d FROM lineitem) UNION ALL
SELECT 'part', p_partkey, {_cardinal_sql('c // 100')} || ' ' || {_plural_sql('c // 100', 'рубль', 'рубля', 'рублей')} || ' ' || {_cardinal_sql('c % 100', 'f')} || ' ' || {_plural_sql('c % 100', 'копейка', 'копейки', 'копеек')}
FROM (SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS c FROM part) UNION ALL
SELECT 'orders', o_orderkey, {_list(_DAYS)}[day(o_orderdate)] || ' ' || {_list(N.MONTHS_GEN)}[month(o_orderdate)] || ' ' || {_YEAR_SQL} || ' года' FROM (SELECT *, year(o_orderdate) AS y FROM orders) UNION ALL
SELECT 'events', event_id, {_cardinal_sql('h')} || ' ' || {_plural_sql('h', 'час', 'часа', 'часов')} || ' ' || {_cardinal_sql('m', 'f')} || ' ' || {_plural_sql('m', 'минута', 'минуты', 'минут')}
FROM (SELECT event_id, hour(ts) AS h, minute(ts) AS m FROM events) UNION ALL
SELECT 'customer', c_custkey, 'клиент ' || {_cardinal_sql('c_custkey')} FROM customer
""")
def normalise_phrases(spark, sf_dir):
    """The whole chain over a phrase rendered from every row of five tables."""

    def rows(source, key, *shown):
        return _t(spark, sf_dir, source).select(F.lit(source).alias("source"), key.cast("long").alias("key"), F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in shown]).alias("text"))

    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    phrases = rows("lineitem", F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_quantity").cast("long"), " км, ", F.round(F.col("l_discount") * 100).cast("long"), "%")
    for more in (
        rows("part", F.col("p_partkey"), F.floor(cents / 100), " руб. ", cents % 100, " коп."),
        rows("orders", F.col("o_orderkey"), F.date_format("o_orderdate", "dd.MM.yyyy")),
        rows("events", F.col("event_id"), F.date_format("ts", "HH:mm")),
        rows("customer", F.col("c_custkey"), "клиент ", F.col("c_custkey")),
    ):
        phrases = phrases.union(more)
    return R.normalise_distinct(phrases).select("source", "key", "text")


@query("""
SELECT page_id, regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:www\\.)?([^/?#:]+)', 1) AS host FROM pages
""")
def page_hosts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", R.url_host(F.col("url")).alias("host"))


@query(None)
def page_text(spark, sf_dir):
    """Readable text of raw pages; checked against a reference implementation in the tests."""
    return _t(spark, sf_dir, "pages").select("page_id", R.strip_markup(F.col("html")).alias("text"))


@query("""
SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_user_turn FROM conversations
""")
def carry_forward(spark, sf_dir):
    """The last user turn before each turn."""
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("turn")).alias("_u"))
    out = S.carry_forward(rows, ["conv_id"], "turn", "_u", "last_user_turn").drop("_u")
    return out.withColumn("last_user_turn", F.coalesce("last_user_turn", F.lit(-1)))


_X = "(SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""
SELECT vec_id, i::INTEGER AS i, round(min(x) OVER w, 6) AS low, round(avg(x) OVER w, 6) AS mean FROM {_X} WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
""")
def sliding_frames(spark, sf_dir):
    x = P.explode_samples(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("x", F.col("x").cast("double"))
    return P.sliding(x, "vec_id", 3).select("vec_id", "i", F.round("low", 6).alias("low"), F.round("mean", 6).alias("mean"))


@query(f"""
WITH f AS (SELECT vec_id, i // 8 AS f, sqrt(avg(x * x)) AS r, count(*) AS n FROM {_X} GROUP BY ALL), t AS (SELECT *, max(r) OVER (PARTITION BY vec_id) AS top FROM f)
SELECT vec_id, round(CASE WHEN max(top) <= 1e-4 THEN 0 ELSE sqrt(sum(r * r * n) / sum(n)) END, 6) AS level FROM t WHERE r >= top / 10 GROUP BY vec_id
""")
def voiced_level(spark, sf_dir):
    x = P.explode_samples(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("x", F.col("x").cast("double"))
    return P.voiced_level(x, "vec_id", 8).select("vec_id", F.round("level", 6).alias("level"))


@query("""
WITH a AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x, len(embedding) AS n FROM embeddings)
SELECT vec_id, sum(greatest(-32767, least(32767, round(x * least(i, n - 1 - i, 10) / 10.0 * 32767))))::BIGINT AS total FROM a GROUP BY vec_id
""")
def faded_shorts(spark, sf_dir):
    """Edge fade, then saturating 16-bit conversion; summed per vector."""
    y = P.to_shorts(P.faded(F.transform("embedding", lambda x: x.cast("double")), 10))
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(y, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("""
WITH e AS (SELECT vec_id, embedding AS a, len(embedding) AS n FROM embeddings), g AS (SELECT vec_id, a, n, unnest(range(0, (n * 3) // 2)) AS k FROM e),
     p AS (SELECT vec_id, k, floor(k * 2 / 3.0)::BIGINT AS l, k * 2 / 3.0::DOUBLE AS pos, a, n FROM g)
SELECT vec_id, count(*) AS n, round(sum(a[l + 1]::DOUBLE + (a[least(l + 1, n - 1) + 1]::DOUBLE - a[l + 1]::DOUBLE) * (pos - l)), 4) AS total FROM p GROUP BY vec_id
""")
def resampled(spark, sf_dir):
    y = P.resampled(F.transform("embedding", lambda x: x.cast("double")), 2, 3)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.size(y).cast("long").alias("n"), F.round(F.aggregate(y, F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("""
SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type
""")
def json_property(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
""")
def session_windows(spark, sf_dir):
    from ..streaming.streams import sessions

    return sessions(_t(spark, sf_dir, "events"), "30 minutes", "1 hour").withColumn("total", F.round("total", 4))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS starts, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ends, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def tumbling_windows(spark, sf_dir):
    from ..streaming.streams import tumbling

    return tumbling(_t(spark, sf_dir, "events"), "1 hour", "1 hour").withColumn("total", F.round("total", 4))


@query(f"""
WITH w AS (SELECT DISTINCT lower(token) AS word FROM {_TOK_SQL}), s(stem, value) AS (VALUES ('the', 1), ('thea', 2), ('ein', 3), ('eau', 4), ('tion', 5), ('inth', 6)),
     m AS (SELECT word, value, row_number() OVER (PARTITION BY word ORDER BY length(stem) DESC) AS r FROM w JOIN s ON starts_with(word, stem))
SELECT word, value FROM m WHERE r = 1
""")
def stem_lookup(spark, sf_dir):
    """The entry of the longest listed beginning of every distinct word."""
    stems = spark.createDataFrame([("the", 1), ("thea", 2), ("ein", 3), ("eau", 4), ("tion", 5), ("inth", 6)], "stem string, value int")
    return L.longest_stem(_tokens(spark, sf_dir).select(F.lower("token").alias("word")).distinct(), stems, "word")


@query(f"""
WITH d AS (SELECT doc_id, list_distinct(list_transform({_WORDS_SQL.format('text')}, lambda w: lower(w))) AS ws FROM documents),
     r(rule_id, tokens) AS (VALUES (1, ['the', 'with']), (2, ['idiot']), (3, ['der', 'und', 'nicht']), (4, ['que', 'dans']))
SELECT doc_id, rule_id FROM d JOIN r ON list_has_all(ws, tokens)
""")
def rule_candidates(spark, sf_dir):
    """Documents that hold every word of a rule: an equi-join on the anchor, then containment."""
    rows = [(1, ["the", "with"], "with"), (2, ["idiot"], "idiot"), (3, ["der", "und", "nicht"], "nicht"), (4, ["que", "dans"], "dans")]
    rules = spark.createDataFrame(rows, "rule_id int, tokens array<string>, anchor string")
    return L.replacement_candidates(_t(spark, sf_dir, "documents"), rules, "doc_id", "text")


@query(f"""
WITH t AS (SELECT doc_id, tok_no, CASE WHEN regexp_full_match(token, '[A-Za-z]{{2,}}(?:[''’-][A-Za-z]+)*') THEN 2 WHEN regexp_full_match(token, '[A-Za-z]|\\d+') THEN 1 ELSE 0 END AS k FROM {_TOK_SQL} WHERE lang = 'fr'),
     r AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tok_no ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT doc_id, min(tok_no) FILTER (k = 2) AS "first", max(tok_no) FILTER (k = 2) AS "last", count(*) FILTER (k = 2) AS words FROM r WHERE k > 0 GROUP BY doc_id, run HAVING count(*) FILTER (k = 2) >= 12
""")
def unaccented_runs(spark, sf_dir):
    """Long runs of plain Latin words in French text (gaps and islands)."""
    t = _tokens(spark, sf_dir).where("lang = 'fr'")
    return S.foreign_runs(t, ["doc_id"], "tok_no", "token", 12)


@query(f"""
WITH t AS (SELECT doc_id, lang, tok_no, CASE WHEN regexp_full_match(token, '[A-Za-z]{{2,}}(?:[''’-][A-Za-z]+)*') THEN 2 WHEN regexp_full_match(token, '[A-Za-z]|\\d+') THEN 1 ELSE 0 END AS k FROM {_TOK_SQL}),
     r AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, lang ORDER BY tok_no ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT doc_id, lang, min(tok_no) FILTER (k = 2) AS "first", max(tok_no) FILTER (k = 2) AS "last", count(*) FILTER (k = 2) AS words FROM r WHERE k > 0 GROUP BY doc_id, lang, run HAVING count(*) FILTER (k = 2) >= 12
""")
def unaccented_runs_by_lang(spark, sf_dir):
    """Long runs of plain Latin words in every text, whatever its language."""
    return S.foreign_runs(_tokens(spark, sf_dir), ["doc_id", "lang"], "tok_no", "token", 12)


@query("""
WITH v AS (SELECT doc_id, quality AS a, toxic AS b FROM labels), d AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS c FROM documents)
SELECT doc_id, a AS variant FROM v JOIN d USING (doc_id) WHERE a <> b AND c = a
""")
def arbitration(spark, sf_dir):
    """Variants that a voter backs, none contradicts, and the model misses."""
    cand = _t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("variant"))
    model = _t(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("variant"))
    voter = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 500, "1").otherwise("0").alias("variant"))
    out = C.arbitrate(cand.withColumn("variant", F.col("variant").cast("string")), {"length": voter}, model, "doc_id")
    return out.withColumn("variant", F.col("variant").cast("int"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) AS place FROM embeddings")
def first_argmax(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", L.first_argmax(F.col("embedding")).cast("int").alias("place"))


def _slavic_sql(n: str, lang: str, feminine: bool) -> str:
    """Below a million, nominative."""

    def under(x: str, female: bool) -> str:
        u, t, h = V.small_words(lang, "nom", female)
        rest = f"(({x}) % 100)"
        return (
            f"concat_ws(' ', nullif({_list(h)}[({x}) // 100 + 1], ''), CASE WHEN {rest} < 20 THEN nullif({_list(u)}[{rest} + 1], '') "
            f"ELSE concat_ws(' ', {_list(t)}[{rest} // 10 + 1], nullif({_list(u)}[{rest} % 10 + 1], '')) END)"
        )

    table = V._NUMERALS[lang, "nom"]
    high = f"nullif(({n}) // 1000, 0)"
    thousand = f"CASE WHEN ({n}) >= 1000 THEN {under(high, True)} || ' ' || {_plural_sql(high, *table.scales[0])} END"
    return f"CASE WHEN ({n}) = 0 THEN '{table.zero}' ELSE concat_ws(' ', {thousand}, nullif({under(f'({n}) % 1000', feminine)}, '')) END"


def _slavic_queries(lang: str, noun: tuple[str, str, str]) -> None:
    def balance(spark, sf_dir):
        """Whole balances in words."""
        n = F.floor(F.abs("c_acctbal")).cast("long")
        return _t(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", V.cardinal(n, lang), V.plural(n, noun)).alias("said"))

    def day(spark, sf_dir):
        """Order dates rendered as dd.mm. and read back."""
        return _t(spark, sf_dir, "orders").select("o_orderkey", V.day_month(F.date_format("o_orderdate", "dd.MM."), lang).alias("said"))

    def clock(spark, sf_dir):
        return _t(spark, sf_dir, "events").select("event_id", V.times(F.date_format("ts", "HH:mm"), lang).alias("said"))

    QUERIES[f"balance_words_{lang}"] = balance
    ORACLE_SQL[f"balance_words_{lang}"] = f"SELECT c_custkey, {_slavic_sql('n', lang, False)} || ' ' || {_plural_sql('n', *noun)} AS said FROM (SELECT c_custkey, floor(abs(c_acctbal))::BIGINT AS n FROM customer)"
    QUERIES[f"order_day_words_{lang}"] = day
    ORACLE_SQL[f"order_day_words_{lang}"] = f"SELECT o_orderkey, {_list(V.day_words(lang))}[day(o_orderdate)] || ' ' || {_list(V.MONTHS[lang])}[month(o_orderdate)] AS said FROM orders"
    QUERIES[f"event_time_words_{lang}"] = clock
    ORACLE_SQL[f"event_time_words_{lang}"] = (
        f"SELECT event_id, {_slavic_sql('h', lang, True)} || ' ' || {_plural_sql('h', *V.HOURS[lang])} || ' ' || {_slavic_sql('m', lang, True)} || ' ' || {_plural_sql('m', *V.MINUTES[lang])} AS said "
        "FROM (SELECT event_id, hour(ts) AS h, minute(ts) AS m FROM events)"
    )


_slavic_queries("uk", ("гривня", "гривні", "гривень"))
_slavic_queries("be", ("рубель", "рублі", "рублёў"))
