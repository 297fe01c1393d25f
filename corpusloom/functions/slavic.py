"""Ukrainian and Belarusian numerals as column expressions, in the nominative and genitive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerals import _pick, plural_form
from .regexmap import let, regex_map


@dataclass(frozen=True)
class Tables:
    """Words of one language and case: 1 to 19 (masculine), feminine and neuter 1 and 2, tens from
    20, hundreds, and scale nouns for one, a few and many."""

    units: list[str]
    feminine: list[str]
    tens: list[str]
    hundreds: list[str]
    scales: list[tuple[str, str, str]]
    zero: str


_NUMERALS = {
    ("uk", "nom"): Tables(
        "один два три чотири п’ять шість сім вісім дев’ять десять одинадцять дванадцять тринадцять чотирнадцять п’ятнадцять шістнадцять сімнадцять вісімнадцять дев’ятнадцять".split(),
        ["одна", "дві"],
        "двадцять тридцять сорок п’ятдесят шістдесят сімдесят вісімдесят дев’яносто".split(),
        "сто двісті триста чотириста п’ятсот шістсот сімсот вісімсот дев’ятсот".split(),
        [("тисяча", "тисячі", "тисяч"), ("мільйон", "мільйони", "мільйонів"), ("мільярд", "мільярди", "мільярдів")],
        "нуль",
    ),
    ("uk", "gen"): Tables(
        "одного двох трьох чотирьох п’яти шести семи восьми дев’яти десяти одинадцяти дванадцяти тринадцяти чотирнадцяти п’ятнадцяти шістнадцяти сімнадцяти вісімнадцяти дев’ятнадцяти".split(),
        ["однієї", "двох"],
        "двадцяти тридцяти сорока п’ятдесяти шістдесяти сімдесяти вісімдесяти дев’яноста".split(),
        "ста двохсот трьохсот чотирьохсот п’ятисот шестисот семисот восьмисот дев’ятисот".split(),
        [("тисячі", "тисяч", "тисяч"), ("мільйона", "мільйонів", "мільйонів"), ("мільярда", "мільярдів", "мільярдів")],
        "нуля",
    ),
    ("be", "nom"): Tables(
        "адзін два тры чатыры пяць шэсць сем восем дзевяць дзесяць адзінаццаць дванаццаць трынаццаць чатырнаццаць пятнаццаць шаснаццаць сямнаццаць васямнаццаць дзевятнаццаць".split(),
        ["адна", "дзве"],
        "дваццаць трыццаць сорак пяцьдзясят шэсцьдзясят семдзесят восемдзесят дзевяноста".split(),
        "сто дзвесце трыста чатырыста пяцьсот шэсцьсот семсот восемсот дзевяцьсот".split(),
        [("тысяча", "тысячы", "тысяч"), ("мільён", "мільёны", "мільёнаў"), ("мільярд", "мільярды", "мільярдаў")],
        "нуль",
    ),
    ("be", "gen"): Tables(
        "аднаго двух трох чатырох пяці шасці сямі васьмі дзевяці дзесяці адзінаццаці дванаццаці трынаццаці чатырнаццаці пятнаццаці шаснаццаці сямнаццаці васямнаццаці дзевятнаццаці".split(),
        ["адной", "дзвюх"],
        "дваццаці трыццаці сарака пяцідзесяці шасцідзесяці сямідзесяці васьмідзесяці дзевяноста".split(),
        "ста двухсот трохсот чатырохсот пяцісот шасцісот сямісот васьмісот дзевяцісот".split(),
        [("тысячы", "тысяч", "тысяч"), ("мільёна", "мільёнаў", "мільёнаў"), ("мільярда", "мільярдаў", "мільярдаў")],
        "нуля",
    ),
}

#: Ordinals 1 to 31 of days in the genitive, and the months.
DAYS = {
    "uk": "першого другого третього четвертого п’ятого шостого сьомого восьмого дев’ятого десятого одинадцятого дванадцятого тринадцятого чотирнадцятого п’ятнадцятого шістнадцятого сімнадцятого вісімнадцятого дев’ятнадцятого двадцятого".split(),
    "be": "першага другога трэцяга чацвёртага пятага шостага сёмага восьмага дзявятага дзясятага адзінаццатага дванаццатага трынаццатага чатырнаццатага пятнаццатага шаснаццатага сямнаццатага васямнаццатага дзевятнаццатага дваццатага".split(),
}
_TENS = {"uk": ("двадцять", "тридцять", "тридцятого"), "be": ("дваццаць", "трыццаць", "трыццатага")}
MONTHS = {
    "uk": "січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня".split(),
    "be": "студзеня лютага сакавіка красавіка мая чэрвеня ліпеня жніўня верасня кастрычніка лістапада снежня".split(),
}
HOURS = {"uk": ("година", "години", "годин"), "be": ("гадзіна", "гадзіны", "гадзін")}
MINUTES = {"uk": ("хвилина", "хвилини", "хвилин"), "be": ("хвіліна", "хвіліны", "хвілін")}


def day_words(lang: str) -> list[str]:
    """The days 1 to 31 in the genitive."""
    first, (twenty, thirty, thirtieth) = DAYS[lang], _TENS[lang]
    return [*first, *[f"{twenty} {w}" for w in first[:9]], thirtieth, f"{thirty} {first[0]}"]


def small_words(lang: str, case: str, feminine: bool) -> tuple[list[str], list[str], list[str]]:
    t = _NUMERALS[lang, case]
    units = ["", *(t.feminine if feminine else t.units[:2]), *t.units[2:]]
    return units, ["", "", *t.tens], ["", *t.hundreds]


def cardinal(n: Column, lang: str, case: str = "nom", feminine: bool = False) -> Column:
    """The number in words, below 10^12; null for null."""
    return let(n.cast("long"), lambda v: _cardinal(v, lang, case, feminine))


def _cardinal(n: Column, lang: str, case: str, feminine: bool) -> Column:
    t, size = _NUMERALS[lang, case], F.abs(n)

    def under(x: Column, female: bool) -> Column:
        units, tens, hundreds = small_words(lang, case, female)
        rest = x % 100
        return F.array(
            _pick(hundreds, F.floor(x / 100)), F.when(rest < 20, F.lit("")).otherwise(_pick(tens, F.floor(rest / 10))), _pick(units, F.when(rest < 20, rest).otherwise(rest % 10))
        )

    words = []
    for i in range(len(t.scales), 0, -1):
        group = F.floor(size / 1000**i) % 1000
        words.append(F.when(group > 0, F.concat(under(group, i == 1), F.array(_pick(list(t.scales[i - 1]), plural_form(group))))).otherwise(F.array().cast("array<string>")))
    words.append(under(size % 1000, feminine))
    said = F.array_join(F.filter(F.concat(*words), lambda w: w != ""), " ")
    return F.when(n == 0, t.zero).otherwise(F.concat(F.when(n < 0, "мінус ").otherwise(""), said))


def plural(n: Column, forms: tuple[str, str, str]) -> Column:
    return _pick(list(forms), plural_form(n))


def day_month(text: Column, lang: str) -> Column:
    """``dd.mm.`` or ``dd.mm.yyyy``: the day as a genitive ordinal and the month; the year stays a
    cardinal for a later pass. Ranges are checked, the calendar isn't."""

    def say(m, d, mo, y, *_):
        day, month = d.cast("int"), mo.cast("int")
        ok = day.between(1, 31) & month.between(1, 12)
        return F.when(ok, F.concat(F.concat_ws(" ", _pick(day_words(lang), day - 1), _pick(MONTHS[lang], month - 1)), F.when(y != "", F.concat(F.lit(" "), y)).otherwise("")))

    return regex_map(text, r"(?<![\d.])(\d{1,2})\.(\d{1,2})\.(\d{4})?(?!\d)", 3, say)


def times(text: Column, lang: str) -> Column:
    def say(m, h, mi, *_):
        hour, minute = h.cast("int"), mi.cast("int")
        words = F.concat_ws(" ", cardinal(hour, lang, feminine=True), plural(hour, HOURS[lang]), cardinal(minute, lang, feminine=True), plural(minute, MINUTES[lang]))
        return F.when(hour.between(0, 23) & minute.between(0, 59), words)

    return regex_map(text, r"(?<![\d:])(\d{1,2}):(\d{2})(?![\d:])", 2, say)


def short_u(text: Column) -> Column:
    """Belarusian: «у» after a vowel and a space becomes «ў»."""
    return F.regexp_replace(text, r"(?<=[аеёіоуыэюя] )у(?=\s|[^\p{L}\s]|\p{L})", "ў")
