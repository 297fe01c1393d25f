"""Corpus jobs: counts, votes, arbitration, concordance, sampling, evaluation.

All are keyed aggregations with map-side combine, equi-joins, or windows over a key. Windows that
rank keep only what their rank needs after a first aggregation, so a hot key is reduced before it
is ordered wherever the result allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variant_counts(df: DataFrame, key: Column, variant: Column) -> DataFrame:
    """How often each variant of a key occurs."""
    return df.groupBy(key.alias("key"), variant.alias("variant")).agg(F.count("*").alias("n"))


def majority(counts: DataFrame, key: str = "key", variant: str = "variant", n: str = "n") -> DataFrame:
    """Each key's most frequent variant (the least one among equals), its count and the total."""
    best = F.min_by(F.struct(variant, n), F.struct(-F.col(n), F.col(variant)))
    out = counts.groupBy(key).agg(best.alias("best"), F.sum(n).alias("total"))
    return out.select(key, F.col(f"best.{variant}").alias(variant), F.col(f"best.{n}").alias(n), "total")


def shared_majority(counts: DataFrame, least: int, share: float) -> DataFrame:
    """Majorities with at least ``least`` occurrences and a share of at least ``share``."""
    return majority(counts).where((F.col("total") >= least) & (F.col("n") >= share * F.col("total")))


def first_and_count(df: DataFrame, key: str, order: Column, kept: list[str]) -> DataFrame:
    """Occurrences of each key, with the kept columns of the first one."""
    first = [F.min_by(c, order).alias(f"first_{c}") for c in kept]
    return df.groupBy(key).agg(*first, F.count("*").alias("n"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sample_per_group(df: DataFrame, group: list[str], unique: str, k: int, seed: int) -> DataFrame:
    """At most ``k`` rows of each group, chosen by a hash of a unique column; repeatable. Ranks
    are cut within hash slices first, so a hot group is thinned before one task orders it."""
    draw = F.xxhash64(F.col(unique), F.lit(seed))
    rows = df.withColumn("_draw", draw).withColumn("_slice", F.pmod(F.xxhash64(F.col(unique)), F.lit(64)))
    thin = Window.partitionBy(*group, "_slice").orderBy("_draw", unique)
    full = Window.partitionBy(*group).orderBy("_draw", unique)
    rows = rows.withColumn("_rank", F.row_number().over(thin)).where(F.col("_rank") <= k)
    return rows.withColumn("_rank", F.row_number().over(full)).where(F.col("_rank") <= k).drop("_rank", "_draw", "_slice")


def last_line_wins(lines: DataFrame, key: str, priority: str, line: str) -> DataFrame:
    """Merge of word lists: of equal keys the row of the greatest priority and line stays."""
    rest = [c for c in lines.columns if c != key]
    best = lines.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(priority, line)).alias("row"))
    return best.select(key, "row.*")


def without_keys(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """A full list less removed keys; keys compare in lower case."""
    return rows.withColumn("_k", F.lower(key)).join(removed.select(F.lower(key).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def arbitrate(candidates: DataFrame, votes: dict[str, DataFrame], model: DataFrame, key: str = "word") -> DataFrame:
    """Candidate variants that at least one voter backs, no voter contradicts and the model misses."""
    out = candidates
    names = list(votes)
    for name, voter in votes.items():
        out = out.join(voter.select(key, F.col("variant").alias(f"_{name}")), key, "left")
    out = out.join(model.select(key, F.col("variant").alias("_model")), key, "left")
    voted = F.array_distinct(F.filter(F.array(*[F.col(f"_{n}") for n in names]), lambda v: v.isNotNull()))
    return out.where((F.size(voted) == 1) & (F.get(voted, F.lit(0)) == F.col("variant")) & (F.coalesce("_model", F.lit("")) != F.col("variant"))).select(*candidates.columns)


def contexts(tokens: DataFrame, keys: list[str], order: str, token: str, targets: Column) -> DataFrame:
    """Left, right and two-sided contexts of the target tokens."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = tokens.withColumn("left", F.lag(token).over(w)).withColumn("right", F.lead(token).over(w)).where(targets)
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.concat_ws(" ", "left", token).alias("phrase")),
        F.struct(F.lit("right").alias("side"), F.concat_ws(" ", token, "right").alias("phrase")),
        F.struct(F.lit("both").alias("side"), F.concat_ws(" ", "left", token, "right").alias("phrase")),
    )
    return near.select(*keys, order, F.explode(sides).alias("c")).select(*keys, order, "c.side", "c.phrase")


def contexts_in_texts(texts: DataFrame, keys: list[str], words: Column, targets: list[str]) -> DataFrame:
    """The same for texts given as arrays of words: neighbours are read by index within the row, and
    only the target words leave it, so nothing is shuffled or sorted."""
    rows = texts.select(*keys, words.alias("_w"))
    near = F.transform("_w", lambda w, i: F.struct(i.alias("tok_no"), F.get("_w", i - 1).alias("left"), w.alias("token"), F.get("_w", i + 1).alias("right")))
    hits = rows.select(*keys, F.explode(F.filter(near, lambda x: F.lower(x["token"]).isin(*targets))).alias("x"))
    sides = [F.struct(F.lit(side).alias("side"), F.concat_ws(" ", *[F.col(f"x.{c}") for c in cols]).alias("phrase")) for side, cols in (("left", ("left", "token")), ("right", ("token", "right")), ("both", ("left", "token", "right")))]
    return hits.select(*keys, F.col("x.tok_no").alias("tok_no"), F.explode(F.array(*sides)).alias("c")).select(*keys, "tok_no", "c.side", "c.phrase")


def citation(text: Column, at: Column, length: Column, before: int = 24, after: int = 36) -> Column:
    """A window around a place in a text (from 1), cut to whole words at both ends."""
    first = F.greatest(F.lit(1), at - before)
    piece = text.substr(first, at + length + after - first)
    piece = F.when(first > 1, F.regexp_replace(piece, r"^\S*\s+", "")).otherwise(piece)
    return F.when(at + length + after <= F.length(text), F.regexp_replace(piece, r"\s+\S*$", "")).otherwise(piece)


def within_budget(df: DataFrame, group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The rows, in order, whose running size stays within the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def accuracy(df: DataFrame, right: Column, *levels: str) -> DataFrame:
    """Rows, right ones and their share for every level and in total."""
    return df.rollup(*levels).agg(F.count("*").alias("n"), F.sum(right.cast("int")).alias("n_right"), F.round(F.avg(right.cast("double")), 6).alias("share"))
