"""Long texts: the work grows with the text, and letters keep their places."""

import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import batches as B
from corpusloom.functions import marks as M
from corpusloom.functions import offsets as O
from corpusloom.functions import rules as R
from corpusloom.operators import homographs as H
from corpusloom.operators import lexicon as L
from corpusloom.operators import names as N
from corpusloom.operators import wordmarks as W
from corpusloom.operators import yo as Y


def one(spark, text, *columns):
    return spark.createDataFrame([(1, text)], "id long, text string").select(*columns).first()


@pytest.mark.parametrize("limit", [0, None])
def test_capitals_are_one_letter(spark, limit):
    """ß has the capital ẞ, so SS is another word."""
    lines = spark.createDataFrame([("ßieë",)], "value string")
    texts = spark.createDataFrame([(1, "ßiee SSiee ẞiee")], "id long, text string")
    got = Y.restore(texts, Y.table(Y.entries(lines, "ëË", "eE"), "ëË"), "id", dotted="ëË", plain="eE", limit=limit).first().text
    assert got == "ßieë SSiee ẞieë"


def test_surnames_of_a_long_text(spark):
    """a text is split once and not for each of its words."""
    texts = spark.createDataFrame([(1, "with Maria " * 40_000), (2, None), (3, "")], "id long, text string")
    table = spark.createDataFrame([("maria", "m+aria")], "word string, variant string")
    began = time.time()
    assert N.surnames(texts, table, "id").count() == 40_000
    assert time.time() - began < 60


def test_vowel_places_of_a_long_text(spark):
    """letters aren't looked up from the text's beginning."""
    began = time.time()
    got = one(spark, "мОлоко é" * 100_000, L.vowel_places(F.col("text"), "аеёиоуыэюя").alias("p")).p
    assert len(got) == 300_000 and got[:4] == [2, 4, 6, 10] and time.time() - began < 30
    row = one(spark, "", L.vowel_places(F.col("text"), "о").alias("p"), L.vowel_places(F.lit(None).cast("string"), "о").alias("n"))
    assert (row.p, row.n) == ([], None)


def test_source_sums_and_slices(spark):
    """sums by piece are those of all places; parts of a batch are small and in order."""
    for text in ("a.{pause:250} the{pause:40} b\n{prosody:90:110} *c d* é{pause:9}", "", "{pause:1}", "x"):
        df = spark.createDataFrame([(text,)], "text string").select(W.marked(F.col("text")).alias("t"))
        row = df.select(O.sources(F.col("t")).alias("s"), O.source_sum(F.col("t")).alias("n")).first()
        assert row.n == sum((i + 1) * s for i, s in enumerate(row.s))
    batch = pa.array(["x" * n for n in (1, 5000, 3, 1, 1, 2000)])
    parts = list(B.slices(batch, 2100))
    assert pa.concat_arrays(parts).equals(batch) and all(p.nbytes <= 2100 or len(p) == 1 for p in parts) and len(parts) > 1


def test_replacing_the_tokens_of_a_long_text(spark):
    """replaced tokens aren't searched once for each token."""
    texts = spark.createDataFrame([(1, "-" + "ab cd, " * 40_000), (2, "x y"), (3, None), (4, "")], "id long, text string")
    rows = spark.range(80_000).where("id % 3 < 2").select(F.lit(1).cast("long").alias("key"), F.col("id").cast("int").alias("tok_no"), F.when(F.col("id") != 1, F.lit("z")).alias("shown"))
    began = time.time()
    got = {r.id: r.text for r in H.replaced_tokens(texts, rows.withColumnRenamed("key", "id"), "id").collect()}
    words = [("cd" if i % 2 else "ab") if i % 3 == 2 or i == 1 else "z" for i in range(80_000)]
    assert got == {1: "-" + "".join(f"{w}, " if i % 2 else f"{w} " for i, w in enumerate(words)), 2: "x y", 3: None, 4: ""}
    assert time.time() - began < 40


def test_repeated_texts_are_normalised_once(spark):
    """as the chain over every row gives it, with null and empty texts."""
    rows = spark.createDataFrame([(1, "5 км, 7%"), (2, "5 км, 7%"), (3, None), (4, ""), (5, "12:30")], "id long, text string")
    few = R.Switches(frozenset(k for k, _, on in R._chain() if on and k not in ("times", "units", "percents")))
    made = R.normalise_distinct(rows, switches=few)
    assert {r.id: r.text for r in made.collect()} == {r.id: r.text for r in R.normalise(rows, switches=few).collect()}
    assert sorted(made.columns) == ["id", "text"]


NEEDED = ["5", "п. 2.3.1 и 5² + 3 = 8", "а г. Москва и т. д.", "в XX веке", "на одна книгу о один", "Mосква", "слово⁵ и word[12].", "-5 ~7 ±2 №4 §5 ≥ 5 5€ 3/4 12:30 01.02.2003 5x6 20°C", "ab5 5ab", "на ᲀек", "(a) = -b", "x >= y", "no such thing", "", None]


def test_rules_that_are_passed_by_would_change_nothing(spark):
    """a text without what a rule needs stays as the rule leaves it."""
    from corpusloom.plans.examples import EXAMPLES

    texts = NEEDED + [t for _, rows in EXAMPLES.values() for t, _ in rows if isinstance(t, str)]
    bare = [re.sub("[0-9²³⁰-⁹Ѐ-ԯ]", "", t) for t in texts if t]
    df = spark.createDataFrame([(t,) for t in texts + bare], "t string").repartition(1)
    rules = [(k, r) for k, r, _ in R._chain() if k in R._NEEDS]
    assert len(rules) == len(R._NEEDS)
    for k, rule in rules:
        got = df.select("t", rule(F.col("t")).alias("a"), R.where_needed(k, rule, F.col("t")).alias("b")).collect()
        assert [r for r in got if r.a != r.b] == [], k
