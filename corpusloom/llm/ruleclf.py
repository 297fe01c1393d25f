"""Sparse rule ensemble for document quality.

1. Statistics of a text (counts and ratios) are columns of numbers.
2. Shallow decision trees are grown on labelled rows; every path from a root to a node is a
   conjunctive rule over the statistics.
3. A lasso-penalised logistic regression over the rules leaves a few of them with a weight.
4. The kept rules compile into one Spark column expression, so scoring is a projection.

Trees and weights are fitted by Spark ML on the executors, over all labelled rows of the learning
part; only trees (bounded by their number and depth) and weights reach the driver.

Cases: null and empty texts have zero counts and are scored like any other; rows without a label
don't take part in learning; several labels for one id all count; with labels of one kind only
(or none) the score is the share of good labels, 0.5 if there are none. Extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import bound_batches, forget, free_name, in_learning_part, materialise, small

STATISTICS = (
    "n_words",
    "word_length",
    "upper_share",
    "digit_share",
    "symbol_share",
    "stop_share",
    "other_share",
    "wide_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "words_per_line",
)


@dataclass(frozen=True)
class Settings:
    trees: int = 10
    depth: int = 3
    lasso: float = 0.001
    iterations: int = 30
    threshold: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, bound) tests, and its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, stats: str) -> Column:
        out = F.lit(True)
        for name, low, bound in self.tests:
            value = F.col(f"{stats}.{name}")
            out = out & (value <= F.lit(bound) if low else value > F.lit(bound))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def score(self, stats: str) -> Column:
        """The probability of label 1, as an expression over a struct column of statistics."""
        z = F.lit(float(self.intercept))
        for rule in self.rules:
            z = z + F.when(rule.holds(stats), F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def statistics(text: Column) -> Column:
    """The statistics of a text as a struct of doubles; zeros for null."""

    @F.arrow_udf("struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        forget()
        parts: list[np.ndarray] = []
        for _, _, t in K.pieces(texts):
            base, chars, _, _ = K.basic_counts(t)
            words, length = np.maximum(base["n_words"], 1), np.maximum(base["word_chars"], 1)
            lines = np.maximum(base["n_lines"], 1)
            share = chars / length[:, None]
            parts.append(
                np.stack([
                    base["n_words"], base["word_chars"] / words, share[:, 1], share[:, 2], share[:, 3], share[:, 5], share[:, 6], share[:, 7],
                    base["n_dup_lines"] / lines, base["n_repeat_words"] / words, base["n_distinct_words"] / words, base["n_words"] / lines,
                ])
            )
        table = np.concatenate(parts, axis=1) if parts else np.zeros((len(STATISTICS), 0))
        return pa.StructArray.from_arrays([pa.array(row, pa.float64()) for row in table], names=list(STATISTICS))

    return run(text)


def _paths(node, tests: tuple) -> list[tuple]:
    """The tests on the way to each node below a tree's root (a node of Spark ML's JVM tree)."""
    if node.subtreeDepth() == 0:
        return []
    split = node.split()
    name, bound = STATISTICS[split.featureIndex()], float(split.threshold())
    out = []
    for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
        # of two bounds on one side of a statistic only the tighter one matters
        same = [b for n, lo, b in tests if n == name and lo == low]
        rest = tuple(x for x in tests if x[:2] != (name, low))
        tight = (min if low else max)([bound, *same])
        own = tuple(sorted([*rest, (name, low, tight)]))
        out += [own, *_paths(child, own)]
    return out


def fit(labelled: DataFrame, settings: Settings = Settings()) -> RuleModel:
    """``labelled``: a struct column ``stats`` and ``label`` (0 or 1)."""
    rows = labelled.where("label in (0, 1)").select("stats", F.col("label").cast("double").alias("label"))
    share = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        p = 0.5 if not share else min(max(next(iter(share)), 0.02), 0.98)
        return RuleModel(float(np.log(p / (1 - p))))
    flat = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows.select("label", "stats.*")).select("label", "features")
    forest = RandomForestClassifier(
        numTrees=settings.trees, maxDepth=settings.depth, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=settings.seed
    ).fit(flat)
    found: set[tuple] = set()
    for tree in forest.trees:
        found.update(_paths(tree._call_java("rootNode"), ()))
    rules = [Rule(tests) for tests in sorted(found)]
    names = [f"r{i}" for i in range(len(rules))]
    marks = rows.select("label", *[r.holds("stats").cast("double").alias(n) for n, r in zip(names, rules, strict=True)])
    marks = VectorAssembler(inputCols=names, outputCol="features").transform(marks).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=settings.lasso, maxIter=settings.iterations, standardization=True).fit(marks)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [Rule(r.tests, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9])


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> RuleModel:
    """Learns from the rows of ``docs`` (doc_id and a struct ``stats``) in the learning part."""
    own = _own_labels(labels)
    rows = docs.where(in_learning_part(F.col("doc_id"))).select(F.col("doc_id").alias("_doc"), "stats").join(own, "_doc")
    return fit(materialise(rows.select("stats", "label")), settings)


def _own_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("_doc"), F.col("quality").alias("label")).where("label is not null and _doc is not null")


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) with ``quality_score`` and
    ``quality_good`` (the score is at least the threshold), each with an underscore behind it where one of
    ``keep`` has its name."""
    bound_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    score, good = (free_name(docs.select(*keep), c) for c in ("quality_score", "quality_good"))
    stats, id_ = statistics(F.col("text")).alias("stats"), F.col("doc_id").alias("doc_id")
    row = F.struct(*keep).alias("row")  # in a struct of their own, columns can't clash with ours
    if "text" in keep:
        # of the texts, only the labelled ones are read for learning
        known = materialise(_own_labels(labels).select("_doc").distinct())
        texts = docs.where(in_learning_part(F.col("doc_id"))).select("doc_id", "text")
        texts = texts.join(small(known, known.count()), F.col("doc_id") == F.col("_doc"), "left_semi")
        learned = learn(materialise(texts.select(id_, stats)), labels, settings)
        rated = docs.select(row, stats)
    else:
        rated = materialise(docs.select(row, id_, stats))
        learned = learn(rated, labels, settings)
    out = rated.select(*[F.col("row")[c].alias(c) for c in keep], learned.score("stats").alias(score))
    return out.withColumn(good, F.col(score) >= settings.threshold)
