"""The grammar pass: a word's reading from the words and morphology around it, by rules that are data.

A rule is a line ``tests -> picks``. It holds if all its tests do; the first rule that holds decides, by
the first of its picks that the word has (``-`` or none that it has: no reading, and no later rule). A test
is ``offset what values`` with offsets from -4 to 2, 0 being the word itself:

    -1 word до|из|у         the word there is one of these; ``!word``: there is one, and it is none of them
    -1 ends ого|его         its ending; ``starts``: its beginning
    -1 is noun              it has one of these tags; ``!is``: it has none of them
    -1 agrees gen.sg        an adjective there and the word share one of these cells, and in gender
    0 has p                 the word has this reading; ``!has``
    -1 near                 there is a word, and but for space nothing between it and its neighbour
                            towards the word; ``!near``: not so
    -1 none                 there is no word

Rules become one column expression over an array of (word, tags, near), so a text's words are judged in
one row, without Python and without a window's shuffle. Tags are those of ``morph``, 0 where a word isn't in
the table: such a word is nothing and agrees with nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions.regexmap import let
from . import morph as M
from .lexicon import folded, with_dimension

_TAGS = {"feminine": M.FEMININE, "neuter": M.NEUTER, "animate": M.ANIMATE, "noun": M.NOUN, "adjective": M.ADJECTIVE, "verb": M.VERB}
_TESTS = {"word": True, "ends": True, "starts": True, "is": True, "agrees": True, "has": True, "near": False, "none": False}
_LEFT, _RIGHT = -4, 2


class RuleError(ValueError):
    """What is wrong with a rule, and in which line (from 1)."""

    def __init__(self, line: int, kind: str, text: str):
        super().__init__(f"line {line}: {kind}: {text}")
        self.line, self.kind = line, kind


@dataclass(frozen=True)
class Test:
    offset: int
    what: str
    values: tuple[str, ...]
    negated: bool


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    picks: tuple[str, ...]


def tag_bits(names: tuple[str, ...]) -> int:
    """``noun``, ``adjective`` and so on, or cells like ``gen.sg``, as bits."""
    out = 0
    for name in names:
        if name in _TAGS:
            out |= _TAGS[name]
        else:
            case, _, number = name.partition(".")
            if case not in N.CASES or number not in ("sg", "pl"):
                raise KeyError(name)
            out |= M.cell_bit(number, case)
    return out


def parse(lines: list[str]) -> list[Rule]:
    """Rules of a list; blanks and lines with # are left out. Raises ``RuleError``."""
    out = []
    for number, line in enumerate(lines, 1):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        left, arrow, right = text.rpartition("->")
        if not arrow or not right.split():
            raise RuleError(number, "no picks", text)
        tests = []
        for part in filter(None, (p.strip() for p in left.split(","))):
            m = re.fullmatch(r"([+-]?\d+)\s+(!?)(\w+)(?:\s+(\S+))?", part)
            if not m or m[3] not in _TESTS or bool(m[4]) != _TESTS[m[3]]:
                raise RuleError(number, "no such test", part)
            if not _LEFT <= int(m[1]) <= _RIGHT:
                raise RuleError(number, "offset out of reach", part)
            values = tuple((m[4] or "").split("|"))
            if m[3] in ("is", "agrees"):
                try:
                    tag_bits(values)
                except KeyError as name:
                    raise RuleError(number, "no such tag", str(name)) from None
            tests.append(Test(int(m[1]), m[3], values, bool(m[2])))
        out.append(Rule(tuple(tests), tuple(right.split())))
    return out


def genders(tags: Column) -> Column:
    """Bits of the genders that a noun may have: 1 masculine, 2 feminine, 4 neuter."""
    feminine, neuter = M.has(tags, M.FEMININE), M.has(tags, M.NEUTER)
    return F.when(feminine | neuter, F.when(feminine, 2).otherwise(0) + F.when(neuter, 4).otherwise(0)).otherwise(1)


def agrees(adjective: Column, noun: Column, cells: int) -> Column:
    """An adjective and a noun share one of ``cells``; singular cells need a gender in common, too."""
    shared = M.agreeing_cells(adjective, noun)
    plural = cells & ~((1 << 6) - 1)
    fits = genders(adjective).bitwiseAND(genders(noun)) != 0
    in_plural = shared.bitwiseAND(F.lit(plural)) != 0
    in_singular = (shared.bitwiseAND(F.lit(cells & ((1 << 6) - 1))) != 0) & fits
    return M.has(adjective, M.ADJECTIVE) & M.has(noun, M.NOUN) & (in_plural | in_singular)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _holds(test: Test, tokens: Column, at: Column, readings: Column) -> Column:
    """The test as a condition that is never null."""
    there = F.when(at + test.offset >= 0, F.get(tokens, at + test.offset))
    word, tags, values = there["word"], there["tags"], test.values
    if test.what == "none":
        return word.isNotNull() if test.negated else word.isNull()
    if test.what == "near":
        # ``near`` of a word: only space stands before it
        border = there["near"] if test.offset > 0 else F.get(tokens, at + test.offset + 1)["near"]
        found = F.coalesce(word.isNotNull() & border, F.lit(False))
        return ~found if test.negated else found
    if test.what == "has":
        found = _any([F.array_contains(F.map_keys(readings), v) for v in values])
        return ~found if test.negated else found
    if test.what == "word":
        found = word.isin(*values)
    elif test.what == "ends":
        found = _any([word.endswith(v) for v in values])
    elif test.what == "starts":
        found = _any([word.startswith(v) for v in values])
    elif test.what == "is":
        found = M.has(tags, tag_bits(values))
    else:
        found = agrees(tags, F.get(tokens, at)["tags"], tag_bits(values))
    return F.coalesce(~found if test.negated else found, F.lit(False))


def decide(rules: list[Rule], tokens: Column, at: Column, readings: Column) -> Column:
    """The reading of the word at ``at`` (from 0) of ``tokens``, an array of (word, tags, near);
    ``readings``: map of its readings by key. Null where no rule holds or a rule says so."""
    out = None
    for rule in rules:
        holds = reduce(lambda a, b: a & b, [_holds(t, tokens, at, readings) for t in rule.tests], F.lit(True))
        picks = [F.try_element_at(readings, F.lit(p)) for p in rule.picks if p != "-"]
        pick = F.coalesce(*picks) if picks else F.lit(None).cast("string")
        out = F.when(holds, pick) if out is None else out.when(holds, pick)
    return out if out is not None else F.lit(None).cast("string")


def judge(rows: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """``key``, tok_no, word and reading of every word that a rule decides. ``rows``: key, tokens (array of
    word, tags, near, readings; readings null for words with one)."""

    def one(tokens: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i)["readings"].isNotNull())
        own = F.transform(places, lambda i: let(F.get(tokens, i)["readings"], lambda r: F.struct(i.alias("tok_no"), F.get(tokens, i)["word"].alias("word"), decide(rules, tokens, i, r).alias("reading"))))
        return F.filter(own, lambda s: s["reading"].isNotNull())

    found = rows.where(F.size("tokens") > 0).select(key, F.explode(let(F.col("tokens"), one)).alias("r"))
    return found.select(key, "r.*")


def tokenise(texts: DataFrame, tags: DataFrame, readings: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and tokens for ``judge``: words with their tags (form, tags; keys with е for ё) and readings
    (word, readings). The tables are joined to distinct words; a text's words then meet again."""
    pattern = r"[\p{L}+-]+"
    t = F.col(text)
    words = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    gaps = F.split(t, pattern, -1)
    pairs = F.transform(words, lambda w, i: F.struct(F.lower(w).alias("word"), ((i > 0) & F.get(gaps, i).rlike(r"^\s+$")).alias("near")))
    each = texts.select(key, F.posexplode(pairs).alias("tok_no", "w")).select(key, "tok_no", "w.*")
    distinct = each.select("word").distinct().withColumn("form", folded(F.replace("word", F.lit("+"), F.lit(""))))
    known = with_dimension(with_dimension(distinct, tags.select("form", "tags"), "form"), readings.select("word", "readings"), "word").drop("form")
    full = each.join(known, "word", "left")
    token = F.struct("tok_no", "word", F.coalesce("tags", F.lit(0)).cast("long").alias("tags"), "near", "readings")
    return full.groupBy(key).agg(F.array_sort(F.collect_list(token), lambda a, b: a["tok_no"] - b["tok_no"]).alias("tokens"))


#: Which stress a Russian word takes after these words: g genitive singular, p plural, n nominative,
#: v verb, l second locative.
RUSSIAN = [
    "-1 !near -> -",
    "-1 word под|за, -2 word из -> g n",
    "-1 word за, -2 word что -> -",
    "-1 word с, -2 word размером|высотой|ростом|длиной|шириной|толщиной|весом -> p",
    "-1 word без|близ|вдоль|возле|вокруг|для|до|из|из-за|из-под|кроме|мимо|около|от|после|против|ради|среди|у -> g n",
    "-1 word много|мало|немного|сколько|столько|несколько -> g",
    "-1 starts косн|каса|прикосн, -2 starts котор -> -",
    "-1 starts косн|каса|прикосн -> g",
    "-1 word в|во|на|при, 0 has l, -2 starts брос|попа|сун|вбе|вле|кинул|толкн -> g",
    "-1 word в|во|на|при, 0 has l -> l",
    "-1 word в|во, 0 has g, 0 !has p -> -",
    "-1 word в|во|на|за|под|через|про|сквозь|о|об|по|при|к|ко|над|перед|между -> p g n",
    "-1 word я|ты|он|она|оно|мы|вы|они -> v",
    "-1 ends вшего|ющего|ущего|ащего|ящего -> -",
    "-1 word его|него|чего|кого|ничего|никого|всего|много|итого|отчего -> -",
    "-1 ends ого|его -> g n",
    "-2 word два|две|три|четыре|оба|обе|полтора, -1 is adjective -> g",
    "-1 agrees gen.sg, -1 agrees nom.pl|acc.pl -> -",
    "-1 agrees gen.sg -> g",
    "-1 agrees nom.pl|acc.pl -> p",
    "-1 is noun, -1 !is adjective, 0 is animate, 0 !has p -> g",
]
