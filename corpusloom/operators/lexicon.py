"""Dictionary look-ups and the replacement engine.

Look-ups join exploded tokens with dimension tables. A dimension is broadcast only after its bytes
are summed; a larger one is joined by shuffle. Rules are a hand-kept list and are compiled once: each is
filed under a literal piece that every match of it must hold, so a text meets only rules whose piece it
has, wildcards and regular expressions included.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache, cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BROADCAST_BYTES = 48 << 20
_FEW_RUNS = 256


def with_dimension(rows: DataFrame, dimension: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Joins a table that is broadcast if its values, written out, take at most ``_BROADCAST_BYTES``."""
    size = dimension.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32), F.lit(0))).first()[0]
    return rows.join(F.broadcast(dimension) if size <= _BROADCAST_BYTES else dimension, on, how)


def folded(word: Column) -> Column:
    """The key of a word: lower case, ё as е."""
    return F.translate(F.lower(word), "ё", "е")


def longest_stem(words: DataFrame, stems: DataFrame, word: str, least: int = 3) -> DataFrame:
    """Each word's entry, or that of its longest listed beginning: the word's prefixes are joined
    by equality, so the work is in proportion to the words' lengths."""
    own = words.select(word, F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.length(word), F.lit(least))), lambda i: F.substring(F.col(word), F.lit(1), i))).alias("stem"))
    return with_dimension(own, stems, "stem", "inner").groupBy(word).agg(F.max_by("value", F.length("stem")).alias("value"))


def first_argmax(p: Column) -> Column:
    """The place (from 1) of the first greatest element."""
    return F.array_position(p, F.array_max(p))


def vowel_places(word: Column, vowels: str) -> Column:
    """Places (from 1) of a word's vowels."""
    # split into letters once: a substring is searched from the beginning, which makes long texts quadratic
    places = F.transform(F.split(word, ""), lambda c, i: F.when(F.lit(vowels).contains(F.lower(c)) & (c != ""), i + 1))
    return F.filter(places, lambda i: i.isNotNull())


def mark_vowel(word: Column, place: Column) -> Column:
    """A plus sign before the character at ``place``."""
    return F.when(place.isNull() | (place < 1), word).otherwise(F.concat(F.substring(word, F.lit(1), place - 1), F.lit("+"), F.substring(word, place, F.length(word))))


def stress(words: DataFrame, dictionary: DataFrame, predictions: DataFrame, vowels: str) -> DataFrame:
    """word and stressed: the dictionary's variant; an existing mark; no mark on words of one
    vowel; else the vowel of the first greatest probability. Distinct words only are looked up."""
    distinct = words.select("word").distinct()
    found = with_dimension(with_dimension(distinct, dictionary.select("word", "variant"), "word"), predictions.select("word", "p"), "word")
    places = vowel_places(F.col("word"), vowels)
    guess = F.when(F.size(places) > 1, mark_vowel(F.col("word"), F.get(places, (first_argmax(F.col("p")) - 1).cast("int")))).otherwise(F.col("word"))
    return found.select("word", F.coalesce("variant", F.when(F.col("word").contains("+"), F.col("word")), guess, F.col("word")).alias("stressed"))


@dataclass(frozen=True)
class Replacement:
    """A compiled rule: its pattern and value, the words that must all occur, and the literal pieces of
    which every match holds each (folded)."""

    key: str
    value: str
    source: str
    flags: int
    words: frozenset[str]
    pieces: tuple[str, ...]

    @cached_property
    def pattern(self) -> re.Pattern:
        return re.compile(self.source, self.flags)


@dataclass(frozen=True)
class RuleProblem:
    """Why a line (from 1) gives no rule: ``separator`` (it has none, or no key), ``pattern`` (it doesn't
    compile), ``group`` (the value names one that the pattern lacks), ``dollar`` (a lone one), ``backslash``
    (one at the end)."""

    line: int
    kind: str
    text: str


_WORD = re.compile(r"\w+", re.UNICODE)


def parse_rule(line: str) -> tuple[str, str] | None:
    """``key = value``; a regex key (``~``) splits at the first " = ", others at the first "=".
    Comments (#) and blanks give none; ``##`` stands for a literal number sign."""
    text = line.strip()
    if not text or (text[0] == "#" and not text.startswith("##")):
        return None
    cut = text.find(" = ") if text[0] == "~" else text.find("=")
    if cut <= 0:
        return None
    key, value = text[:cut].strip(), text[cut + (3 if text[0] == "~" else 1) :].strip()
    return (key.replace("##", "#"), value.replace("##", "#")) if key else None


@cache
def _alike() -> dict[int, str]:
    """Characters that a pattern without regard to case takes for others than their lower case."""
    out = {}
    for code in range(0x80, 0x1_0000):
        c = chr(code)
        folded = c.upper().lower() if len(c.upper()) == 1 else c.lower()
        if folded[0] != c.lower() or len(folded) > 1:
            out[code] = folded[0]
    return out


@cache
def _alike_pattern() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in _alike()) + "]")


def fold_case(text: str) -> str:
    """Equal for texts that differ in case only, character for character."""
    return text.translate(_alike()).lower() if not text.isascii() and _alike_pattern().search(text) else text.lower()


def required_pieces(source: str, flags: int) -> tuple[str, ...]:
    """Folded literal runs that every match of the pattern holds, from its parse: what is optional, one of
    several or a class ends a run; look-around has no part in it."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            out.append(fold_case("".join(run)))
            run.clear()

    def walk(parsed) -> None:
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(value))
            elif name == "SUBPATTERN":
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                end()
                if value[0] >= 1:
                    walk(value[2])
                    end()
            elif name == "ATOMIC_GROUP":
                walk(value)
            elif name not in ("ASSERT", "ASSERT_NOT", "AT"):
                end()

    walk(re._parser.parse(source, flags))
    end()
    return tuple(dict.fromkeys(out))


def _value_problem(value: str, groups: int) -> str | None:
    i = 0
    while i < len(value):
        if value[i] == "\\":
            if i + 1 == len(value):
                return "backslash"
            i += 1
        elif value[i] == "$":
            if not value[i + 1 : i + 2].isdigit():
                return "dollar"
            if int(value[i + 1]) > groups:
                return "group"
        i += 1
    return None


def _regex_rule(key: str, value: str) -> tuple[Replacement | None, str | None]:
    """The rule of a ``~`` key, or what is wrong with it."""
    flags = re.UNICODE | re.IGNORECASE
    try:
        groups = re.compile(key[1:], flags).groups
        pieces = required_pieces(key[1:], flags)
    except (re.error, RecursionError):
        return None, "pattern"
    if (problem := _value_problem(value, groups)) is not None:
        return None, problem
    made = re.sub(r"\\(.)|\$(\d)", lambda m: rf"\g<{m[2]}>" if m[2] else m[1].replace("\\", r"\\"), value)
    return Replacement(key, made, key[1:], flags, frozenset(), pieces), None


def _plain_rule(key: str, value: str) -> Replacement:
    """The rule of a literal or wildcard key; ``$`` in front heeds case."""
    body, flags = key.lstrip("$"), re.UNICODE if key[0] == "$" else re.UNICODE | re.IGNORECASE
    parts = body.split("*")
    source = r"([\w-]*)".join(re.escape(p).replace(",", r",\s*") for p in parts)
    left, right = r"(?<!\w)" if re.match(r"\w", body) else "", r"(?!\w)" if re.search(r"\w$", body) else ""
    words = frozenset(w.lower() for w in _WORD.findall(re.sub(r"\w*\*\w*", " ", body)))
    pieces = tuple(dict.fromkeys(fold_case(q.strip()) for p in parts for q in re.split(r"(?<=,)", p) if q.strip()))
    value = value.replace("\\", "\\\\")
    for n in range(body.count("*")):
        value = value.replace("*", rf"\g<{n + 1}>", 1)
    return Replacement(key, value, left + source + right, flags, words, pieces)


def compile_rules(lines: list[str], problems: list[RuleProblem] | None = None) -> list[Replacement]:
    """Of equal keys the last one counts; longer keys come first. Kinds: ``~regex``, ``$case``
    sensitive, ``*`` wildcard, literal (whole words where the key begins or ends with one). Lines that
    give no rule are left out; ``problems`` takes them, with the reason."""
    last: dict[str, tuple[int, str]] = {}
    for number, line in enumerate(lines, 1):
        if (pair := parse_rule(line)) is not None:
            key = pair[0] if pair[0][0] in "~$" else pair[0].lower()
            last.pop(key, None)
            last[key] = number, pair[1]
        elif problems is not None and line.strip() and (line.strip()[0] != "#" or line.strip().startswith("##")):
            problems.append(RuleProblem(number, "separator", line.strip()))
    out = []
    for key, (number, value) in last.items():
        if key[0] == "~":
            rule, problem = _regex_rule(key, value)
            if rule is None:
                if problems is not None:
                    problems.append(RuleProblem(number, problem, key))
                continue
        else:
            rule = _plain_rule(key, value)
        out.append(rule)
    return sorted(out, key=lambda r: -len(r.key))


class RuleIndex:
    """Rules with whole words are filed under their rarest word, the others under the rarest run of three
    characters of their literal pieces (or a shorter piece). The words of the text as given decide on the
    former; runs are looked up again whenever a rule has changed the text, as later rules see what earlier
    ones made. A rule's pattern is compiled when a text first holds all its pieces."""

    def __init__(self, rules: list[Replacement]):
        self.rules = rules
        word_use: Counter[str] = Counter(w for r in rules for w in r.words)
        run_use: Counter[str] = Counter(g for r in rules if not r.words for g in {g for p in r.pieces for g in self._runs(p)})
        self.always: list[int] = []
        self.by_word: dict[str, list[int]] = {}
        self.by_run: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            if r.words:
                self.by_word.setdefault(min(r.words, key=lambda w: (word_use[w], -len(w), w)), []).append(i)
            elif r.pieces:
                self.by_run.setdefault(min((g for p in r.pieces for g in self._runs(p)), key=lambda g: (-len(g), run_use[g], g)), []).append(i)
            else:
                self.always.append(i)
        self.sizes = sorted({len(g) for g in self.by_run})

    @staticmethod
    def _runs(piece: str) -> list[str]:
        return [piece[i : i + 3] for i in range(max(1, len(piece) - 2))]

    def _by_runs(self, folded: str, after: int) -> list[int]:
        if len(self.by_run) <= _FEW_RUNS:  # searching a text for each is faster than cutting it into runs
            found = {i for run, own in self.by_run.items() if run in folded for i in own}
        else:
            found = {i for size in self.sizes for run in {folded[i : i + size] for i in range(len(folded) - size + 1)} & self.by_run.keys() for i in self.by_run[run]}
        return sorted(i for i in found.union(self.always) if i > after)

    def apply(self, text: str) -> str:
        words = {w.lower() for w in _WORD.findall(text)} if self.by_word else set()
        by_word = sorted(i for w in words for i in self.by_word.get(w, ()) if self.rules[i].words <= words)
        folded = fold_case(text)
        by_run, w, g, end = self._by_runs(folded, -1), 0, 0, len(self.rules)
        while (i := min(by_word[w] if w < len(by_word) else end, by_run[g] if g < len(by_run) else end)) < end:
            if w < len(by_word) and by_word[w] == i:
                w += 1
            else:
                g += 1
            rule = self.rules[i]
            if all(p in folded for p in rule.pieces):
                made = rule.pattern.sub(rule.value, text)
                if made != text:
                    text, folded = made, fold_case(made)
                    by_run, g = self._by_runs(folded, i), 0
        return re.sub(r" {2,}", " ", text).strip()


def replace(text: Column, lines: list[str]) -> Column:
    """Applies a replacement list; order matters (later rules see earlier outputs), so the rules
    run together in one Arrow-batched function."""
    index = RuleIndex(compile_rules(lines))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: index.apply(t) if t is not None else None)

    return run(text)


def replacement_candidates(texts: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule_id) where every word of a rule occurs: an equi-join on the rule's anchor, then
    containment. ``rules``: rule_id, tokens, anchor."""
    words = texts.select(key, F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)).alias("words"))
    anchors = rules.select("anchor").distinct()
    if anchors.count() <= 10_000:  # only anchors leave a text's array, not each of its words
        listed = F.array(*[F.lit(r.anchor) for r in anchors.collect()]).cast("array<string>")
        words = words.select(key, "words", F.explode(F.array_intersect("words", listed)).alias("anchor"))
    else:
        words = words.select(key, "words", F.explode("words").alias("anchor"))
    found = with_dimension(words, rules, "anchor", "inner")
    return found.where(F.forall("tokens", lambda t: F.array_contains(F.col("words"), t))).select(key, "rule_id")
