"""Passes over the words of whole texts that a dictionary decides: stress by a user's dictionary, and the hard
vowel of borrowed words.

A text's different words are looked up once, by joins with the dictionary; what they become returns to the
texts by word and place. A word is letters with stress marks (+), with hyphens between its parts. Null and
empty texts stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .homographs import cased, replaced_tokens
from .lexicon import folded, longest_stem, with_dimension

_WORD = r"[\p{L}+]+(?:-[\p{L}+]+)*"
_PART = r"[\p{L}+]+"


def _bare(word: Column) -> Column:
    return F.replace(word, F.lit("+"), F.lit(""))


def _tokens(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("tok_no", "token"))


def _with_sources(tokens: DataFrame, texts: DataFrame, key: str, source: str) -> DataFrame:
    """Adds ``asked``: the word as the source has it in the same place, if the two differ in dots and marks only.
    Dictionaries are written for the words of the source, and earlier passes may have put dots on."""
    given = _tokens(texts, key, source, _WORD).select(key, "tok_no", F.lower(_bare(F.col("token"))).alias("_given"))
    same = folded(F.col("_given")) == folded(_bare(F.col("token")))
    return tokens.join(given, [key, "tok_no"], "left").select(key, "tok_no", "token", F.when(same, F.col("_given")).otherwise(F.lower(_bare(F.col("token")))).alias("asked"))


def user_dictionary(texts: DataFrame, dictionary: DataFrame, key: str, text: str = "text", source: str | None = None) -> DataFrame:
    """``key`` and ``text`` with the variants of ``dictionary`` (word, variant) in place of its words. A word with
    hyphens is looked up whole and then by parts; a part with a stress mark keeps it, and keeps the whole
    from being looked up. Of a word's several variants the first one by code points counts. ``source``: the text before earlier passes."""
    tokens = _tokens(texts, key, text, _WORD)
    tokens = _with_sources(tokens, texts, key, source) if source else tokens.withColumn("asked", F.lower(_bare(F.col("token"))))
    distinct = tokens.select("token", "asked").distinct()
    keys = F.array_distinct(F.concat(F.array("asked"), F.split("asked", "-")))
    listed = dictionary.select(F.lower("word").alias("_key"), "variant").groupBy("_key").agg(F.min("variant").alias("variant"))
    found = with_dimension(distinct.select("token", "asked", F.explode(keys).alias("_key")), listed, "_key", "inner")
    known = found.groupBy("token", "asked").agg(F.map_from_entries(F.collect_list(F.struct("_key", "variant"))).alias("by"))
    whole, parts, asked = F.try_element_at("by", F.col("asked")), F.split("token", "-"), F.split("asked", "-")
    marked = F.col("token").contains("+")

    def part(p: Column, i: Column) -> Column:
        own = F.try_element_at(F.col("by"), F.get(asked, i))
        return F.when(p.contains("+") | own.isNull(), p).otherwise(cased(own, p))

    shown = F.when(~marked & whole.isNotNull(), cased(whole, F.col("token"))).otherwise(F.array_join(F.transform(parts, part), "-"))
    made = known.select("token", "asked", shown.alias("shown")).where("shown <> token")
    return replaced_tokens(texts, tokens.join(made, ["token", "asked"]).select(key, "tok_no", "shown"), key, text, _WORD)


def hard_vowels(texts: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and ``text`` with words as they are said. ``rules`` (word, said): whole words, and beginnings with * behind
    them, of which the longest counts; whole words come first. A rule that would change a word's length
    is left out, so stress marks and capitals stay in their places."""
    tokens = _tokens(texts, key, text, _PART)
    distinct = tokens.select("token").distinct().withColumn("word", F.lower(_bare(F.col("token")))).where("word <> ''")
    listed = rules.select(F.lower("word").alias("word"), F.lower("said").alias("said"))
    whole = listed.where(~F.col("word").endswith("*")).groupBy("word").agg(F.min("said").alias("said"))
    stems = listed.where(F.col("word").endswith("*")).select(F.rtrim(F.col("word"), F.lit("*")).alias("stem"), F.rtrim(F.col("said"), F.lit("*")).alias("value")).groupBy("stem").agg(F.min("value").alias("value"))
    begun = longest_stem(distinct.select("word").distinct(), stems.select("stem", F.struct("stem", "value").alias("value")), "word", 1)
    rows = with_dimension(distinct, whole, "word").join(begun.withColumnRenamed("value", "begun"), "word", "left")
    by_stem = F.concat("begun.value", F.substring(F.col("word"), F.length("begun.stem") + 1, F.length("word")))
    said = rows.withColumn("said", F.coalesce("said", by_stem)).where((F.length("said") == F.length("word")) & (F.col("said") != F.col("word")))
    letters = F.split(_bare(F.col("token")), "")
    new = F.transform(letters, lambda c, i: F.when(c == F.lower(c), F.substring("said", i + 1, F.lit(1))).otherwise(F.upper(F.substring("said", i + 1, F.lit(1)))))

    def marks(t: Column) -> Column:
        """Letters of the old word before each of the new one's, and what stands there: the marks return."""
        return F.transform(F.split(t, ""), lambda c, i: F.when(c == "+", c).otherwise(F.get(new, i - F.length(F.regexp_replace(F.substring(t, F.lit(1), i), r"[^+]", "")))))

    made = said.select("token", F.array_join(marks(F.col("token")), "").alias("shown"))
    return replaced_tokens(texts, tokens.join(made, "token").select(key, "tok_no", "shown"), key, text, _PART)
