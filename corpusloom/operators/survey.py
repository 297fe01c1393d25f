"""Jobs that build and compare word lists: conditional counts, conflicts, sieves, arbitration by set
equality, ordered deduplication, sampling with caps. All are DataFrame plans; hot keys are counted
before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_of_listed(tokens: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Occurrences of the forms in ``listed`` only. Forms are counted first, so the join sees one row
    of each form."""
    return tokens.groupBy(key).agg(F.count("*").alias("n")).join(listed.select(key).distinct(), key, "left_semi")


def context_stats(rows: DataFrame, by: list[str], left: Column, right: Column, least: int, share: float) -> DataFrame:
    """Two conditional counts in each context; contexts with enough rows and a decided majority."""
    out = rows.groupBy(*by).agg(F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"))
    total = F.col("n_left") + F.col("n_right")
    return out.where((total >= least) & (F.greatest("n_left", "n_right") >= share * total))


def single_variant(rows: DataFrame, key: str, variant: str) -> DataFrame:
    """Keys all of whose rows agree in one variant, with it."""
    # the least and the greatest variant are equal exactly if there is one; no set is gathered
    out = rows.where(F.col(variant).isNotNull()).groupBy(key).agg(F.min(variant).alias(variant), F.max(variant).alias("_most"))
    return out.where(F.col(variant) == F.col("_most")).drop("_most")


def conflicts(phrases: DataFrame, word: str, phrase: str, variant: str) -> DataFrame:
    """For each phrase how many other phrases of its word contain it and have another variant. The
    join is on the word; containment is tested within it."""
    a, b = phrases.alias("a"), phrases.alias("b")
    inside = (F.col(f"a.{word}") == F.col(f"b.{word}")) & (F.col(f"a.{phrase}") != F.col(f"b.{phrase}")) & F.col(f"b.{phrase}").contains(F.col(f"a.{phrase}")) & (F.col(f"a.{variant}") != F.col(f"b.{variant}"))
    hits = a.join(b, inside).groupBy(F.col(f"a.{word}").alias(word), F.col(f"a.{phrase}").alias(phrase)).agg(F.count("*").alias("n"))
    return phrases.join(hits, [word, phrase], "left").select(word, phrase, variant, F.coalesce("n", F.lit(0)).alias("conflicts"))


def lift(rows: DataFrame, by: list[str], without: Column, with_: Column) -> DataFrame:
    """How often a phrase fired, how often the answer was right without and with it, and the lift."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(without).alias("n_without"), F.count_if(with_).alias("n_with"))
    return out.withColumn("lift", F.col("n_with") - F.col("n_without"))


def sieve(candidates: DataFrame, present: DataFrame, absent: DataFrame, key: str) -> DataFrame:
    """Candidates that one list holds and another doesn't."""
    return candidates.join(present.select(key).distinct(), key, "left_semi").join(absent.select(key).distinct(), key, "left_anti")


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in a given order (not just any row of it)."""
    best = F.min(F.struct(*order, F.struct(*rows.columns).alias("_row"))).alias("_best")  # combined before the shuffle
    return rows.groupBy(F.col(key).alias("_key")).agg(best).select("_best._row.*")


def latest(rows: DataFrame, when: list[str], keep: int) -> DataFrame:
    """The ``keep`` latest rows by the columns ``when``: a sorted limit, no window over all rows."""
    return rows.orderBy(*[F.desc(c) for c in when]).limit(keep)


def capped_per_group(rows: DataFrame, group: str, cap: int, total: int, *salt: str) -> DataFrame:
    """At most ``cap`` rows of each group, in a pseudo-random order by a hash of ``salt``, then at most
    ``total`` of all in another such order."""
    hashed = F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in salt]))
    order = Window.partitionBy(group).orderBy("_h", *salt)
    few = rows.withColumn("_h", hashed).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap)
    return few.orderBy(F.reverse("_h"), *salt).limit(total).drop("_h", "_r")


def compatible(left: DataFrame, right: DataFrame, form: str, tags: str, features: str) -> DataFrame:
    """Readings of a form whose tags hold all features asked for; forms with exactly one of them.
    An equi-join on the form comes first."""
    both = left.join(right, form).where(F.col(tags).bitwiseAND(F.col(features)) == F.col(features))
    return both.groupBy(form, features).agg(F.count("*").alias("_n"), F.min(tags).alias(tags)).where("_n = 1").drop("_n")


def in_range(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points joined to the ranges that hold them (``low`` <= ``at`` < ``high``): ranges are cut into
    buckets of ``width``, so that the join is on a bucket and no pair of all is looked at."""
    cut = ranges.where(F.col(low) < F.col(high)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    own = points.withColumn("_b", F.floor(F.col(at) / width))
    return own.join(cut, "_b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")
