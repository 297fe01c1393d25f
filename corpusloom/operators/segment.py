"""Segmentation: documents to paragraphs, sentences and tokens, each level with an ordinal column.

Everything is native and row-local (split, posexplode), so no level shuffles; the one exception is
regrouping, which partitions by document. Null and empty texts give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Word tokens: letters and digits with inner apostrophes or hyphens.
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


def numbered(df: DataFrame, parts: Column, name: str, ordinal: str) -> DataFrame:
    """One row per element of ``parts``, with its place from 0."""
    return df.select("*", F.posexplode(parts).alias(ordinal, name))


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """Splits at runs of line ends (CR LF counts as one), trims, drops empty ones; the number
    counts the paragraphs that are left."""
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n+")
    kept = F.filter(F.transform(lines, lambda p: F.trim(p)), lambda p: p != "")
    return numbered(df, kept, "paragraph", "par_no").drop(text)


def dehyphenate(text: Column, keep: tuple[str, ...] = ()) -> Column:
    """Joins a word that a hyphen and a line end part, unless the second half is a capital or the
    first half is one of ``keep`` (prefixes that keep their hyphen)."""
    guard = f"(?<!(?<![\\p{{L}}])(?:{'|'.join(keep)}))" if keep else ""
    return F.regexp_replace(text, rf"(?<=\p{{L}}){guard}-[ \t]*\n[ \t]*(?=\p{{Ll}})", "")


def join_soft_breaks(text: Column) -> Column:
    """A single line end before a lower-case letter is a space."""
    return F.regexp_replace(text, r"(?<!\n)[ \t]*\n(?=\p{Ll})", " ")


def sentence_array(paragraph: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """Splits after sentence marks and white space, but not after a single letter or a listed
    abbreviation."""
    initials = r"(?<!(?<![\p{L}\p{N}])\p{L}[.])"
    listed = "".join(rf"(?<!(?<![\p{{L}}]){a}[.])" for a in abbreviations)
    return F.filter(F.split(paragraph, rf"(?<=[.!?…]){initials}{listed}\s+"), lambda s: F.trim(s) != "")


def sentences(df: DataFrame, paragraph: str = "paragraph", abbreviations: tuple[str, ...] = ()) -> DataFrame:
    return numbered(df, sentence_array(F.col(paragraph), abbreviations), "sentence", "sent_no").drop(paragraph)


def tokens(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    return numbered(df, F.regexp_extract_all(F.col(sentence), F.lit(WORD), F.lit(0)), "token", "tok_no").drop(sentence)


def bounded_pieces(text: Column, limit: int) -> Column:
    """Cuts a sentence into pieces of at most ``limit`` characters: at the last comma, else at the
    last space, else hard. Runs in one greedy pass of a regular expression."""
    n = limit - 1
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(?:.{{1,{n}}},(?!\d)|.{{1,{limit}}}(?=\s|$)|.{{1,{limit}}})\s*"), F.lit(0))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != ""))


def speech_pieces(sentence: Column) -> Column:
    """Direct speech that opens with a dash: pieces between dashes alternate speech and author."""
    body = F.regexp_replace(sentence, r"^\s*[—–-]\s+", "")
    parts = F.split(body, r"(?<=[,.!?…])\s+[—–-]\s+")
    marked = F.transform(parts, lambda p, i: F.struct(F.trim(p).alias("text"), (i % 2 == 0).alias("speech")))
    plain = F.array(F.struct(F.trim(sentence).alias("text"), F.lit(False).alias("speech")))
    return F.when(sentence.rlike(r"^\s*[—–-]\s+"), marked).otherwise(plain)


def sentence_type(sentence: Column, wh_words: tuple[str, ...], tags: tuple[str, ...], alternative: str) -> Column:
    """tag_q, wh_q, alternative_q, general_q, exclam or st."""
    s = F.translate(F.regexp_replace(F.lower(F.trim(sentence)), r"^[\"'«“„]+|[\"'»”“]+$", ""), "ё", "е")
    words = F.slice(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), 1, 8)
    asks = s.rlike(r"\?[!.…]*$")
    tag = s.rlike(rf"(?:^|[\s,])(?:{'|'.join(tags)})\s*\?+[!.…]*$")
    wh = F.exists(F.slice(words, 1, 4), lambda w: w.isin(*wh_words))
    return (
        F.when(asks & tag, "tag_q").when(asks & wh, "wh_q").when(asks & s.rlike(rf"(?<!\p{{L}}){alternative}(?!\p{{L}})"), "alternative_q")
        .when(asks, "general_q").when(s.rlike(r"!$"), "exclam").otherwise("st")
    )


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """The last non-null ``value`` before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, keys: list[str], order: str, breaks: Column, out: str = "island") -> DataFrame:
    """Numbers the runs of rows that ``breaks`` starts."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.sum(breaks.cast("int")).over(w))


def foreign_runs(df: DataFrame, keys: list[str], order: str, token: str, least: int = 2) -> DataFrame:
    """Runs of Latin-script words among others: start, end and words of each run of at least
    ``least`` words. Numbers and single letters extend a run but don't count."""
    kind = F.when(F.col(token).rlike(r"^[A-Za-z]{2,}(?:['’-][A-Za-z]+)*$"), 2).when(F.col(token).rlike(r"^(?:[A-Za-z]|\d+)$"), 1).otherwise(0)
    marked = islands(df.withColumn("_kind", kind), keys, order, F.col("_kind") == 0, "_run")
    runs = marked.where("_kind > 0").groupBy(*keys, "_run").agg(
        F.min(F.when(F.col("_kind") == 2, F.col(order))).alias("first"), F.max(F.when(F.col("_kind") == 2, F.col(order))).alias("last"), F.sum((F.col("_kind") == 2).cast("int")).alias("words")
    )
    return runs.where(F.col("words") >= least).drop("_run")
