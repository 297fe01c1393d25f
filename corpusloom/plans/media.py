"""Queries of dump cleaning, phrase caches and tempo over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wikitext as X
from ..operators import pcm as P
from ..streaming import cache as K
from .registry import _t, query


def _nested(word, depth, inner):
    return F.concat(F.repeat(F.concat(F.lit("{{"), word, F.lit("|")), depth), inner, F.repeat(F.lit("}}"), depth))


@query(r"""
WITH t AS (
  SELECT o_orderkey AS k, o_orderstatus || ' ' || repeat('{{' || o_orderpriority || '|', o_orderkey % 6 + 1) || o_custkey || repeat('}}', o_orderkey % 6 + 1)
         || ' kept' || CASE WHEN o_custkey % 4 = 0 THEN ' }} open {{ ' ELSE '' END || '{{a|{{b}} {{c|{{d}}}} e}}' || o_custkey % 10 AS text FROM orders
  UNION ALL
  SELECT -1 - page_id, 'p ' || repeat('{{' || url || '|', page_id % 6 + 1) || '{{x}}' || repeat('}} ', page_id % 6 + 1) || ' kept ' || url FROM pages),
p AS (SELECT k, generate_subscripts(ps, 1) AS i, unnest(ps) AS part FROM (SELECT k, regexp_extract_all(text, '\{\{|\}\}|[^{}]+|[{}]') AS ps FROM t)),
-- a closing bracket without a partner is where the sum of steps falls to a new low; an opening one, from the end
d AS (SELECT *, CASE part WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END AS step, sum(CASE part WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS s FROM p),
low AS (SELECT *, step = -1 AND s < least(0, coalesce(min(s) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS alone_close,
               step = 1 AND coalesce(min(s) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), s) >= s AS alone_open FROM d),
inside AS (SELECT *, sum(CASE WHEN alone_close OR alone_open THEN 0 ELSE step END) OVER (PARTITION BY k ORDER BY i) AS depth, alone_close OR alone_open OR step = 0 AS stays FROM low)
SELECT k, string_agg(CASE WHEN depth = 0 AND stays THEN part ELSE '' END, '' ORDER BY i) AS plain FROM inside GROUP BY k
""")
def nested_templates(spark, sf_dir):
    """Texts of orders and pages with templates nested one to seven deep, some brackets without partners:
    what stays."""
    o = _t(spark, sf_dir, "orders")
    depth = (F.col("o_orderkey") % 6 + 1).cast("int")
    stray = F.when(F.col("o_custkey") % 4 == 0, " }} open {{ ").otherwise("")
    a = o.select(
        F.col("o_orderkey").alias("k"),
        F.concat("o_orderstatus", F.lit(" "), _nested(F.col("o_orderpriority"), depth, F.col("o_custkey").cast("string")), F.lit(" kept"), stray, F.lit("{{a|{{b}} {{c|{{d}}}} e}}"), (F.col("o_custkey") % 10).cast("string")).alias("text"),
    )
    p = _t(spark, sf_dir, "pages")
    depth = (F.col("page_id") % 6 + 1).cast("int")
    b = p.select((-1 - F.col("page_id")).alias("k"), F.concat(F.lit("p "), F.repeat(F.concat(F.lit("{{"), F.col("url"), F.lit("|")), depth), F.lit("{{x}}"), F.repeat(F.lit("}} "), depth), F.lit(" kept "), F.col("url")).alias("text"))
    return a.union(b).select("k", X.without_templates(F.col("text")).alias("plain"))


_BUDGET = 3000


@query(f"""
WITH r AS (SELECT user_id AS owner, event_type || ':' || event_id % 17 AS phrase, ts, 100 + (ascii(event_type) * 7 + event_id % 17 * 41) % 500 AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type || ':' || event_id % 17) AS i FROM events),
p AS (SELECT *, lag(i) OVER (PARTITION BY owner, phrase ORDER BY i) AS before FROM r),
-- between two requests of a phrase, each other one counts once; it is still there if all of them fit beside it
last_ AS (SELECT owner, phrase, i, size, coalesce(lead(i) OVER (PARTITION BY owner, phrase ORDER BY i), 1000000000) AS again FROM r),
used AS (SELECT p.owner, p.i, sum(l.size) AS bytes FROM p JOIN last_ l ON l.owner = p.owner AND l.i > p.before AND l.i < p.i AND l.again >= p.i GROUP BY p.owner, p.i),
h AS (SELECT p.owner, p.before IS NOT NULL AND coalesce(u.bytes, 0) + p.size <= {_BUDGET} AS hit FROM p LEFT JOIN used u ON u.owner = p.owner AND u.i = p.i)
SELECT owner, count(*) AS n, count_if(hit)::BIGINT AS hits FROM h GROUP BY owner
""")
def phrase_cache_hits(spark, sf_dir):
    """Requests and hits of every user's cache of phrases, replayed over the events in order of time."""
    k = F.col("event_id") % 17
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.concat("event_type", F.lit(":"), k.cast("string")).alias("phrase"), "ts", (100 + (F.ascii("event_type") * 7 + k * 41) % 500).alias("size"))
    return K.replay(rows, _BUDGET).groupBy("owner").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("SELECT vec_id, s AS speed, CAST(floor(len(embedding) / s + 0.5) AS BIGINT) AS n, true AS bounded FROM embeddings, (VALUES (0.5::DOUBLE), (1.0), (1.6)) v(s)")
def tempo_lengths(spark, sf_dir):
    """Every vector as a signal at three speeds: its length, and whether it stays within the source's peak."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    made = rows.select("vec_id", "x", *[P.stretched(F.col("x"), s).alias(f"y{i}") for i, s in enumerate((0.5, 1.0, 1.6))])
    each = made.select("vec_id", "x", F.explode(F.array(*[F.struct(F.lit(s).alias("speed"), F.col(f"y{i}").alias("y")) for i, s in enumerate((0.5, 1.0, 1.6))])).alias("r"))
    peak = lambda a: F.array_max(F.transform(a, F.abs))
    return each.select("vec_id", "r.speed", F.size("r.y").cast("long").alias("n"), (peak(F.col("r.y")) <= peak(F.col("x")) + 1e-9).alias("bounded"))
