"""Structured spans, spelled addresses and segment plans."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import spans as S
from corpusloom.operators import planner as P
from corpusloom.plans import spoken

from .conftest import SF
from .test_rules import value

SPANS = [
    ("date", {"weekday": "1", "day": "5", "month": "11", "year": "2020"}, "воскресенье, пятое декабря две тысячи двадцатого года"), ("date", {"month": "0"}, "январь"),
    ("date", {"day": "7"}, "седьмое число"), ("date", {"day": "40"}, None), ("time", {"hours": "1", "minutes": "0"}, "один час"), ("time", {"minutes": "5"}, None),
    ("money", {"currency": "rub", "integer_part": "5", "fractional_part": "3"}, "пять рублей тридцать копеек"), ("money", {"currency": "JPY", "number": "21"}, "двадцать одна иена"),
    ("money", {"currency": "JPY", "integer_part": "2", "fractional_part": "5"}, "2,5 иены"), ("money", {"currency": "XAU", "number": "3"}, "3 XAU"), ("money", {"currency": "RUB"}, None),
    ("measure", {"number": "5", "unit": "kilometers"}, "5 км"), ("measure", {"number": "2", "unit": "miles"}, "две мили"), ("measure", {"integer_part": "2", "fractional_part": "5", "unit": "mile"}, "2,5 мили"),
    ("measure", {"number": "3", "unit": "furlong"}, "3 furlong"), ("measure", {"unit": "feet", "number": "11"}, "одиннадцать футов"), ("measure", {"unit": "feet"}, None),
    ("ordinal", {"number": "3", "case": "genitive", "gender": "female"}, "третьей"), ("ordinal", {"number": "22", "case": "accusative", "animacy": "animate"}, "двадцать второго"),
    ("ordinal", {"number": "40"}, "сороковой"), ("ordinal", {"number": "x"}, "x"), ("fraction", {"integer_part": "1", "numerator": "1", "denominator": "2"}, "одна целая и 1/2"),
    ("decimal", {"fractional_part": "5"}, "0,5"), ("decimal", {}, None), ("telephone", {"number_parts": "012 345 06 78"}, "ноль двенадцать, триста сорок пять, ноль шесть, семьдесят восемь"),
    ("telephone", {"number_parts": "000"}, "ноль ноль ноль"), ("telephone", {"number_parts": "-"}, None),
    ("telephone", {"country_code": "+7", "number_parts": "0123450678", "extension": "12"}, "плюс семь, ноль двенадцать, триста сорок пять, ноль шесть, семьдесят восемь, добавочный двенадцать"),
    ("electronic", {"username": "a", "domain": "example.com"}, "a@example.com"), ("electronic", {"protocol": "https", "domain": "example.com", "path": "/x", "port": "80"}, "https://example.com:80/x"),
    ("electronic", {"path": "x"}, None), ("digits", {"digits": "007"}, "ноль ноль семь"), ("verbatim", {"verbatim": "A+ б1"}, "эй плюс, бэ один"), ("text", {"text": "  "}, None),
    ("cardinal", {"number": " 5 "}, "5"), ("nope", {"text": "a"}, None), (None, None, None),
]


def test_spans(spark):
    df = spark.createDataFrame([(i, k, a) for i, (k, a, _) in enumerate(SPANS)], "i int, kind string, attrs map<string,string>")
    got = {r.i: r.said for r in df.select("i", S.say(F.col("kind"), F.col("attrs")).alias("said")).collect()}
    assert [got[i] for i in range(len(SPANS))] == [said for *_, said in SPANS]


def test_spans_of_other_languages(spark):
    df = spark.createDataFrame([("digits", {"digits": "07"}), ("date", {"day": "7"})], "kind string, attrs map<string,string>")
    assert [r.said for r in df.select(S.say(F.col("kind"), F.col("attrs"), "be").alias("said")).collect()] == ["0 7", None]


@pytest.mark.parametrize(("n", "groups"), [("12", ["12"]), ("12345", ["12", "345"]), ("1234567", ["123", "45", "67"]), ("12345678", ["1", "234", "56", "78"])])
def test_cut_digits(spark, n, groups):
    assert value(spark, S.cut_digits(F.col("t")), t=n) == groups


def test_addresses(spark):
    assert value(spark, S.spelled_address(F.col("t")), t="https://t.me/c/1?x=2") == "ти точка me слэш си слэш один вопрос экс равно два"
    assert value(spark, S.spelled_address(F.col("t")), t="") == ""


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("Раз. {pause:500} Два {pause:30} три. {pause:100}{pause:200}", [("Раз.", 500), ("Два {pause:30} три.", 300)]), ("{pause:700} Начало.", [("", 700), ("Начало.", 0)]),
        ("{pause:5}", [("", 5)]), ("просто", [("просто", 0)]), ("", []),
    ],
)
def test_pause_markers(spark, text, pieces):
    assert [tuple(p) for p in value(spark, P.pause_pieces(F.col("t")), t=text)] == pieces


def test_joined_pauses(spark):
    got = value(spark, P.joined_pauses(F.split("t", r"\|"), 400, 80), t="Раз,|»|two|три|,|пять")
    assert [tuple(p) for p in got] == [("Раз,", 400), ("two", 80), ("три", 400), ("пять", 0)]


def test_plans_keep_every_word(spark):
    """Against the texts themselves: nothing lost or repeated, no piece too long, the first one short."""
    rows = spoken.segment_plans(spark, SF).orderBy("doc_id", "seg_no").collect()
    got = {}
    for r in rows:
        assert len(r.segment) <= 200 and (r.seg_no > 0 or len(r.segment) <= 100)
        got.setdefault(r.doc_id, []).append(r.segment)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        assert re.findall(r"\w+", "".join(re.sub(r"\s", "", s) for s in got.get(r.doc_id, []))) == re.findall(r"\w+", re.sub(r"\s", "", r.text or ""))


def test_plans_of_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n***\n"), (4, "Да.")], "seg_no_before int, text string")
    assert [tuple(r) for r in P.segments(df).collect()] == [(4, 0, "Да.", 400)]
