"""Letters, symbols, marks and alignment on short inputs."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import letters as X
from corpusloom.operators import align as A

from .test_rules import value


@pytest.mark.parametrize(
    ("rule", "text", "said"),
    [
        (X.acronyms, "США и ООН, USB, НАТО", "эс ша а и о о эн, ю эс би, НАТО"), (X.lone_letters, "ось x и α", "ось экс и альфа"), (X.symbol_names, "a+b", "a плюс b"),
        (X.emoji_names, "да 👍👍 и 👨‍👩‍👧", "да, палец вверх, и, семья"), (X.smiley_names, "да :) и :-(", "да улыбка и грусть"), (X.camel_case, "OpenOffice", "Open Office"),
        (X.codes, "Р-9 и ТУ-007А", "эр девять и тэ у ноль ноль семь а"), (X.word_key, "«Ёлка!»", "елка"), (X.letters_beside_digits, "5800X и S20", "5800 X и S 20"),
        (X.pauses_for_parentheses, "Он (сам) пришёл (да).", "Он, сам, пришёл, да."), (X.render_stress, "з+амок", "за́мок"), (X.soft_sign_gender, "учитель", "m"), (X.soft_sign_gender, "ночь", "f"),
    ],
)
def test_letters(spark, rule, text, said):
    assert value(spark, rule(F.col("t")), t=text) == said


@pytest.mark.parametrize(("word", "gender"), [("олень", "m"), ("конь", "m"), ("словарь", "m"), ("корабль", "m"), ("Декабрь", "m"), ("медаль", "f"), ("метель", "f"), ("модель", "f"), ("дверь", "f"), ("стол", None)])
def test_soft_sign_gender(spark, word, gender):
    assert value(spark, X.soft_sign_gender(F.col("t")), t=word) == gender


def test_final_stop(spark):
    assert tuple(value(spark, X.final_stop(F.col("t")), t="Да,")) == ("Да.", True)
    assert tuple(value(spark, X.final_stop(F.col("t")), t="Да!")) == ("Да!", False)


def test_ssml(spark):
    got = value(spark, A.ssml(F.col("t")), t='<speak>раз <break time="1s"/><prosody rate="fast">два &amp; три</prosody></speak>')
    assert [(s.text, s.pause_ms, s.rate) for s in got] == [("раз", 0, 1.0), ("два & три", 1000, 1.25)]


def test_edits_bring_accents_over(spark):
    df = spark.createDataFrame([("Старый замок стоял.", "ст+арый з+амок ст+оял"), ("Нет.", "нет")], "a string, b string")
    out = df.select(A.apply_edits(F.col("a"), A.edits(F.col("a"), F.col("b"))).alias("x")).collect()
    assert [r.x for r in out] == ["ст+арый з+амок ст+оял.", "нет."]


def test_wordpiece(spark):
    tokens = value(spark, A.basic_tokens(F.col("t")), t="Unaffable, x!")
    assert tokens == ["unaffable", ",", "x", "!"]
    assert A.wordpiece(tokens, frozenset(["un", "##aff", "##able", ",", "!"])) == ["un", "##aff", "##able", ",", "[UNK]", "!"]
    assert value(spark, A.symbol_ids(F.col("t"), {"a": 5, "b": 6}, 1, 2), t="a?b") == [1, 5, 6, 2]
