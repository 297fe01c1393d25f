"""Inflection by classes, both ways, and the build of word lists from it.

A class is a set of rows (strip, add, cell): a lemma that ends in ``strip`` has the form that ends in ``add``
instead, in that cell. Lemmas become forms by one join on the class. Back, a form's endings are joined
by equality with ``add``, so the work is in proportion to a form's letters and not to the classes, and what they
give is kept if it is a lemma of the class. A stress mark (+) stays on its vowel; if the ending that is
stripped had it, it goes to the first vowel of the one that is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import with_dimension


def _stripped(word: Column, n: Column) -> Column:
    return F.substring(word, F.lit(1), F.greatest(F.length(word) - n, F.lit(0)))


def expand(lemmas: DataFrame, classes: DataFrame, vowels: str = "аеёиоуыэюя") -> DataFrame:
    """lemma, class, cell, form (without stress) and stressed of every cell. ``lemmas``: lemma, class;
    ``classes``: class, strip, add, cell."""
    plain = F.replace("lemma", F.lit("+"), F.lit(""))
    at = F.instr("lemma", "+") - 1  # letters before the stressed one; -1: no mark
    rows = with_dimension(lemmas.select("lemma", "class").distinct(), classes.select("class", "strip", "add", "cell"), "class", "inner")
    rows = rows.withColumn("_plain", plain).where(F.col("_plain").endswith(F.col("strip")) | (F.col("strip") == ""))
    stem = _stripped(F.col("_plain"), F.length("strip"))
    form = F.concat(stem, F.col("add"))
    vowel = F.length(F.regexp_extract("add", f"^[^{vowels}]*", 0))
    place = F.when(at < 0, None).when(at < F.length(stem), at).when(vowel < F.length("add"), F.length(stem) + vowel)
    stressed = F.when(place.isNull(), form).otherwise(F.concat(F.substring(form, F.lit(1), place), F.lit("+"), F.substring(form, place + 1, F.length(form))))
    return rows.select("lemma", "class", "cell", form.alias("form"), stressed.alias("stressed"))


def analyse(forms: DataFrame, lemmas: DataFrame, classes: DataFrame, longest: int = 12) -> DataFrame:
    """form, lemma (without stress), class and cell of every reading of the distinct ``forms`` (column
    form). Endings are at most ``longest`` letters."""
    form = F.col("form")
    n = F.least(F.length(form), F.lit(longest))
    cuts = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.alias("k"), F.substring(form, F.length(form) - k + 1, k).alias("add")))
    each = forms.select("form").where("form is not null").distinct().select("form", F.explode(cuts).alias("c")).select("form", "c.k", "c.add")
    back = with_dimension(each, classes.select("class", "strip", "add", "cell"), "add", "inner")
    guess = back.select("form", F.concat(_stripped(form, F.col("k")), F.col("strip")).alias("lemma"), "class", "cell")
    known = lemmas.select(F.replace("lemma", F.lit("+"), F.lit("")).alias("lemma"), "class").distinct()
    return guess.join(known, ["lemma", "class"]).select("form", "lemma", "class", "cell").distinct()


def candidates(lemmas: DataFrame, classes: DataFrame, counts: DataFrame, known: list[DataFrame], least: int = 50, least_form: int = 5, vowels: str = "аеёиоуыэюя") -> DataFrame:
    """Lemmas that occur ``least`` times or more in all their forms, with their forms of ``least_form`` times or
    more: lemma, form, stressed, n, lemma_n. ``counts``: word, n. Words of the lists in ``known`` (column word) drop
    out, one anti-join each, and so do forms that two lemmas stress in two ways."""
    forms = expand(lemmas, classes, vowels).groupBy("lemma", "form").agg(F.min("stressed").alias("stressed"))
    counted = forms.join(counts.select(F.col("word").alias("form"), "n"), "form")
    total = counted.groupBy("lemma").agg(F.sum("n").alias("lemma_n")).where(F.col("lemma_n") >= least)
    kept = counted.join(total, "lemma").where(F.col("n") >= least_form)
    for words in known:
        kept = kept.join(words.select(F.col("word").alias("form")).distinct(), "form", "left_anti")
    torn = kept.groupBy("form").agg(F.count_distinct("stressed").alias("_ways")).where("_ways > 1")
    return kept.join(torn, "form", "left_anti").select("lemma", "form", "stressed", "n", "lemma_n")
