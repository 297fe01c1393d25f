"""Numerals, text rules, lexicon and readers on short inputs."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numerals as N
from corpusloom.functions import rules as R
from corpusloom.functions.regexmap import regex_map
from corpusloom.operators import corpus as C
from corpusloom.operators import lexicon as L
from corpusloom.operators import pcm as P
from corpusloom.operators import segment as S
from corpusloom.sources import readers


def value(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("n", "case", "gender", "said"),
    [
        (0, "nom", "m", "ноль"), (42, "nom", "m", "сорок два"), (1000, "nom", "m", "одна тысяча"), (2500, "nom", "m", "две тысячи пятьсот"),
        (500, "gen", "m", "пятисот"), (500, "ins", "m", "пятьюстами"), (-3, "nom", "f", "минус три"), (21, "acc", "f", "двадцать одну"), (1000000, "dat", "m", "одному миллиону"),
    ],
)
def test_cardinals(spark, n, case, gender, said):
    assert value(spark, N.cardinal(F.col("n"), case, gender), n=n) == said


@pytest.mark.parametrize(("n", "said"), [(3, "третий"), (40, "сороковой"), (2020, "две тысячи двадцатый"), (1900, "тысяча девятисотый"), (90000, "девяностотысячный"), (0, None)])
def test_ordinals(spark, n, said):
    assert value(spark, N.ordinal(F.col("n")), n=n) == said


def test_roman_round_trip(spark):
    rows = spark.range(1, 4000)
    assert rows.where(N.from_roman(N.to_roman(F.col("id"))) != F.col("id")).count() == 0
    assert value(spark, N.from_roman(F.col("t")), t="IIII") is None


@pytest.mark.parametrize(
    ("rule", "text", "said"),
    [
        (R.dates, "05.12.2020", "пятого декабря две тысячи двадцатого года"), (R.dates, "45.12.2020", "45.12.2020"), (R.times, "в 21:30", "в двадцать один час тридцать минут"),
        (R.cases, "около 500 рублей", "около пятисот рублей"), (R.money, "5 руб. 30 коп.", "пять рублей тридцать копеек"), (R.roman, "в XX веке", "в двадцатом веке"),
        (R.thousands, "1 200 читателей", "1 200 читателей"), (R.thousands, "1 200", "1200"), (R.decimals, "3.5", "три целых пять десятых"), (R.percents, "22%", "двадцать два процента"),
        (R.footnotes, "слово[12].", "слово."), (R.homoglyphs, "cлoвo", "слово"), (R.fractions, "1/2", "одна вторая"), (R.punctuation, "да!!! , нет...", "да! , нет…"),
    ],
)
def test_rules(spark, rule, text, said):
    assert value(spark, rule(F.col("t")), t=text) == said


def test_rules_keep_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string")
    for rule in (R.dates, R.thousands, R.homoglyphs, R.strip_markup, R.punctuation):
        assert {r.x for r in rows.select(rule(F.col("t")).alias("x")).collect()} == {None, ""}


def test_switched_off_rules_add_nothing(spark):
    off = R.Switches(frozenset(k for k, _, default in R._chain() if default))
    df = spark.createDataFrame([("5 км",)], "text string")
    assert R.normalise(df, "text", off).first().text == "5 км"
    assert R.Switches().on("dates") and not R.Switches().flipped("dates").on("dates")


def test_regex_map_sees_both_neighbours(spark):
    out = regex_map(F.col("t"), r"\d", 0, lambda m, left, right: F.when(right != "", F.concat(m, F.lit("!"))))
    assert value(spark, out, t="a1b2") == "a1!b2"


def test_markup(spark):
    assert value(spark, R.strip_markup(F.col("t")), t="<p>A &amp; B &#233;</p><script>x</script><br>c &nope; d") == "A & B é\nc &nope; d"


def test_sentences_and_pieces(spark):
    assert value(spark, S.sentence_array(F.col("t"), ("ул",)), t="Дом на ул. Мира. А. Петров пришёл! Да?") == ["Дом на ул. Мира.", "А. Петров пришёл!", "Да?"]
    cut = value(spark, S.bounded_pieces(F.col("t"), 12), t="один два, три четыре пять")
    assert all(len(x) <= 12 for x in cut) and " ".join(cut).replace("  ", " ") == "один два, три четыре пять"
    kinds = [S.sentence_type(F.col("t"), ("кто", "что"), ("не так ли",), "или") for _ in range(1)]
    assert [value(spark, kinds[0], t=t) for t in ("Кто там?", "Да или нет?", "Придёшь?", "Ура!", "Да.", "Это он, не так ли?")] == ["wh_q", "alternative_q", "general_q", "exclam", "st", "tag_q"]
    assert [tuple(x) for x in value(spark, S.speech_pieces(F.col("t")), t="— Да, — сказал он.")] == [("Да,", True), ("сказал он.", False)]
    assert value(spark, S.dehyphenate(F.col("t")), t="сло-\nво и кое-\nкак Нью-\nЙорк") == "слово и коекак Нью-\nЙорк"


def test_replacements_against_a_plain_loop():
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    lines = [f"{' '.join(rng.sample(words, rng.choice([1, 2])))} = {rng.choice(words)}x" for _ in range(200)] + ["~(a)(b) = $2$1", "кот* = пёс*", "# note", "Key = v"]
    rules = L.compile_rules(lines)
    index = L.RuleIndex(rules)
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(12))
        found, want = {w.lower() for w in text.split()}, text
        for r in rules:
            if r.words <= found:
                want = r.pattern.sub(r.value, want)
        assert index.apply(text) == " ".join(want.split())
    assert index.apply("ab котик key") == "ba пёсик v"


def test_stress_merge_and_sampling(spark):
    words = spark.createDataFrame([("мама",), ("дом",), ("замок",), ("рука",)], "word string")
    known = spark.createDataFrame([("замок", "з+амок")], "word string, variant string")
    guess = spark.createDataFrame([("мама", [0.9, 0.1]), ("рука", [0.2, 0.8])], "word string, p array<double>")
    got = {r.word: r.stressed for r in L.stress(words, known, guess, "аеёиоуыэюя").collect()}
    assert got == {"мама": "м+ама", "дом": "дом", "замок": "з+амок", "рука": "рук+а"}
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    a, b = (C.sample_per_group(rows, ["g"], "id", 10, 1).orderBy("id").collect() for _ in range(2))
    assert a == b and len(a) == 20


def test_gain_never_clips(spark):
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, 0.5, -0.9, 0.2] * 20)], "k string, i int, x double")
    assert P.limited_gain(x, "k", 3.0, 4).where(F.abs("y") > P.LIMIT + 1e-9).count() == 0
    edges = P.silent_edges(spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 0.0, 1.0, 0.0])], "k string, i int, x double"), "k", 0.5).first()
    assert (edges.lead, edges.tail) == (2, 1)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("привет".encode("cp1251"))
    (tmp_path / "b.txt").write_bytes("﻿привет".encode())
    assert {r.text for r in readers.read_text_files(spark, str(tmp_path / "*.txt")).collect()} == {"привет"}
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("x.xhtml", "<p>раз</p>")
        z.writestr("y.html", "<p>два</p>")
    assert readers.read_books(spark, str(tmp_path / "c.epub")).first().text == "раз\nдва"
    wav = b"RIFF\0\0\0\0WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<Ihh", 4, 16384, -16384)
    assert readers.read_wav(wav) == ([0.5, -0.5], 8000)
    (tmp_path / "s.lst").write_text("# c\nЗамок з+амок\n\n")
    assert [(r.word, r.variant) for r in readers.read_stress_list(spark, str(tmp_path / "s.lst")).collect()] == [("замок", "з+амок")]
    assert L.parse_rule("~a=b = c") == ("~a=b", "c") and L.parse_rule("# x = y") is None and L.parse_rule("a##b=c") == ("a#b", "c")
