"""Russian numerals as column expressions: plural forms, cardinals and ordinals by case and gender,
decimal fractions, years, Roman numerals, digits in groups.

Every function takes and returns columns, stays inside code generation or higher-order functions,
and gives null for null. Numbers are integers below 10^15 by absolute value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexmap import let

CASES = ("nom", "gen", "dat", "acc", "ins", "pre")
GENDERS = ("m", "f", "n")

# Paradigms of the language, in the order of CASES where there are six.
_ONE = {
    "m": "один одного одному один одним одном".split(),
    "f": "одна одной одной одну одной одной".split(),
    "n": "одно одного одному одно одним одном".split(),
}
_TWO = {
    "m": "два двух двум два двумя двух".split(),
    "f": "две двух двум две двумя двух".split(),
    "n": "два двух двум два двумя двух".split(),
}
_THREE = "три трёх трём три тремя трёх".split()
_FOUR = "четыре четырёх четырём четыре четырьмя четырёх".split()
_SOFT = "пят шест сем вос девят десят одиннадцат двенадцат тринадцат четырнадцат пятнадцат шестнадцат семнадцат восемнадцат девятнадцат двадцат тридцат".split()
_HUNDREDS_LEFT = "пят шест сем вос девят".split()
_ORDINAL_STEMS = {
    1: "перв", 2: "втор", 3: "трет", 4: "четвёрт", 5: "пят", 6: "шест", 7: "седьм", 8: "восьм", 9: "девят", 10: "десят",
    11: "одиннадцат", 12: "двенадцат", 13: "тринадцат", 14: "четырнадцат", 15: "пятнадцат", 16: "шестнадцат", 17: "семнадцат", 18: "восемнадцат", 19: "девятнадцат",
    20: "двадцат", 30: "тридцат", 40: "сороков", 50: "пятидесят", 60: "шестидесят", 70: "семидесят", 80: "восьмидесят", 90: "девяност",
    100: "сот", 200: "двухсот", 300: "трёхсот", 400: "четырёхсот", 500: "пятисот", 600: "шестисот", 700: "семисот", 800: "восьмисот", 900: "девятисот",
}
_HARD = {"m": "ый ого ому ый ым ом".split(), "f": "ая ой ой ую ой ой".split(), "n": "ое ого ому ое ым ом".split()}
_THIRD = {"m": "ий ьего ьему ий ьим ьем".split(), "f": "ья ьей ьей ью ьей ьей".split(), "n": "ье ьего ьему ье ьим ьем".split()}
#: Scale nouns: singular and plural by case; the first is feminine.
_SCALES = [
    ("тысяча тысячи тысяче тысячу тысячей тысяче".split(), "тысячи тысяч тысячам тысячи тысячами тысячах".split()),
    *[
        ([s + e for e in ("", "а", "у", "", "ом", "е")], [s + e for e in ("ы", "ов", "ам", "ы", "ами", "ах")])
        for s in ("миллион", "миллиард", "триллион")
    ],
]


def _soft(stem: str, case: int) -> str:
    """пять, пяти, пятью: the pattern of five and its like; восемь drops its vowel."""
    tail = ("ь", "и", "и", "ь", "ью", "и")[case]
    if stem == "вос":
        return ("восемь", "восьми", "восьми", "восемь", "восемью", "восьми")[case]
    return stem + tail


def unit_words(case: str, gender: str = "m") -> list[str]:
    """Words for 0 to 19 (the empty string for 0)."""
    k = CASES.index(case)
    return ["", _ONE[gender][k], _TWO[gender][k], _THREE[k], _FOUR[k], *[_soft(s, k) for s in _SOFT[:15]]]


def ten_words(case: str) -> list[str]:
    k = CASES.index(case)
    forty = "сорок" if case in ("nom", "acc") else "сорока"
    ninety = "девяносто" if case in ("nom", "acc") else "девяноста"
    left = [_soft(s, k) for s in _HUNDREDS_LEFT[:4]]
    ten = "десят" if case in ("nom", "acc") else _soft("десят", k)
    return ["", "", _soft("двадцат", k), _soft("тридцат", k), forty, *[x + ten for x in left], ninety]


def hundred_words(case: str) -> list[str]:
    k = CASES.index(case)
    if case in ("nom", "acc"):
        few, many, first = ["двести", "триста", "четыреста"], "сот", "сто"
    else:
        tail = {"gen": "сот", "dat": "стам", "ins": "стами", "pre": "стах"}[case]
        few, many, first = [x + tail for x in (_TWO["m"][k], _THREE[k], _FOUR[k])], tail, "ста"
    return ["", first, *few, *[_soft(s, k) + many for s in _HUNDREDS_LEFT]]


def _pick(words: list[str], index: Column) -> Column:
    """The word at ``index``. One string that is split is folded into a constant array when the plan
    is made, and keeps the plan far smaller than an array of literals would."""
    return F.get(F.split(F.lit("|".join(words)), r"\|", -1), index.cast("int"))


def plural_form(n: Column) -> Column:
    """0 for one, 1 for a few, 2 for many."""
    n = F.abs(n)
    unit, teens = n % 10, n % 100
    return F.when(teens.between(11, 19), 2).when(unit == 1, 0).when(unit.between(2, 4), 1).otherwise(2)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The noun form that agrees with ``n``."""
    return _pick([one, few, many], plural_form(n))


def _words_below_1000(case: str, gender: str) -> list[str]:
    units, tens, hundreds = unit_words(case, gender), ten_words(case), hundred_words(case)
    out = []
    for n in range(1000):
        rest = n % 100
        parts = [hundreds[n // 100], units[rest]] if rest < 20 else [hundreds[n // 100], tens[rest // 10], units[rest % 10]]
        out.append(" ".join(w for w in parts if w))
    return out


def _under_1000(n: Column, case: str, gender: str) -> Column:
    """Words for 0 (the empty string) to 999, out of one constant table."""
    return _pick(_words_below_1000(case, gender), n)


def cardinal(n: Column, case: str = "nom", gender: str = "m") -> Column:
    """The number in words; every word declines. Zero and minus are spoken."""
    return let(n.cast("long"), lambda v: _cardinal(v, case, gender))


def _cardinal(n: Column, case: str, gender: str) -> Column:
    k = CASES.index(case)
    size = F.abs(n)
    words = []
    for i in range(len(_SCALES), 0, -1):
        one, more = _SCALES[i - 1]
        # the noun for each group of three digits, from one table of a hundred endings
        forms = [one[k], one[1], more[1]] if case in ("nom", "acc") else [one[k], more[k], more[k]]
        nouns = [forms[2] if 11 <= x <= 19 else forms[0] if x % 10 == 1 else forms[1] if 2 <= x % 10 <= 4 else forms[2] for x in range(100)]
        group = F.floor(size / 1000**i) % 1000
        words.append(F.when(group > 0, F.concat_ws(" ", _under_1000(group, case, "f" if i == 1 else "m"), _pick(nouns, group % 100))))
    rest = size % 1000
    words.append(F.when(rest > 0, _under_1000(rest, case, gender)))
    zero = ("ноль", "ноля", "нолю", "ноль", "нолём", "ноле")[k]
    return F.when(n == 0, zero).otherwise(F.concat(F.when(n < 0, "минус ").otherwise(""), F.concat_ws(" ", *words)))


def _fused_heads() -> list[str]:
    """Genitive numerals without spaces, as round thousands begin; 100 and 90 keep their o."""
    out = [w.replace(" ", "") for w in _words_below_1000("gen", "m")]
    return ["сто" if w == "ста" else w[:-1] + "о" if w.endswith("девяноста") else w for w in out]


def ordinal_words(value: int, case: str, gender: str) -> str:
    """One ordinal adjective (1 to 19, tens, hundreds)."""
    k = CASES.index(case)
    if value == 3:
        return _ORDINAL_STEMS[3] + _THIRD[gender][k]
    ending = _HARD[gender][k]
    if value in (2, 6, 7, 8, 40) and ending == "ый":
        ending = "ой"
    return _ORDINAL_STEMS[value] + ending


def ordinal(n: Column, case: str = "nom", gender: str = "m") -> Column:
    """Only the last component is an ordinal; the head is a cardinal without a leading one before
    the thousand. For 1 to 999999; round thousands are fused with a genitive numeral."""
    return let(n.cast("long"), lambda v: _ordinal(v, case, gender))


def _ordinals_below_1000(case: str, gender: str) -> list[str]:
    """Ordinals for 0 (the empty string) to 999: the last word is the ordinal."""
    heads, out = _words_below_1000("nom", "m"), [""]
    for n in range(1, 1000):
        rest = n % 100
        last = n if rest == 0 else rest if rest < 20 or rest % 10 == 0 else rest % 10
        out.append(" ".join(w for w in (heads[n - last], ordinal_words(last, case, gender)) if w))
    return out


def _ordinal(n: Column, case: str, gender: str) -> Column:
    thousand, rest = F.floor(n / 1000), n % 1000
    fused = F.concat(F.when(thousand == 1, "").otherwise(_pick(_fused_heads(), thousand)), F.lit("тысячн" + _HARD[gender][CASES.index(case)]))
    one, more = _SCALES[0]
    head = F.when(thousand == 1, F.lit(one[0] + " ")).when(thousand > 1, F.concat(_under_1000(thousand, "nom", "f"), F.lit(" "), plural(thousand, one[0], one[1], more[1]), F.lit(" "))).otherwise("")
    return F.when(n <= 0, F.lit(None).cast("string")).when(rest == 0, fused).otherwise(F.concat(head, _pick(_ordinals_below_1000(case, gender), rest)))


#: Denominators by the number of digits, in the genitive plural and for one part.
_PARTS = [("десятых", "десятая"), ("сотых", "сотая"), ("тысячных", "тысячная"), ("десятитысячных", "десятитысячная")]


def decimal_words(whole: Column, digits: Column) -> Column:
    """``whole`` and ``digits`` of a decimal fraction in words; null beyond four digits."""
    k, part = F.length(digits), digits.cast("long")
    one = F.when(plural_form(part) == 0, _pick([p[1] for p in _PARTS], k - 1)).otherwise(_pick([p[0] for p in _PARTS], k - 1))
    head = F.concat(cardinal(whole, gender="f"), F.lit(" "), F.when(plural_form(whole) == 0, "целая").otherwise("целых"))
    return F.when(k.between(1, len(_PARTS)), F.concat(head, F.lit(" "), cardinal(part, gender="f"), F.lit(" "), one))


_ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def to_roman(n: Column) -> Column:
    """1 to 3999 in Roman numerals, else null."""
    digits = []
    for power, (one, five, ten) in ((1000, "M??"), (100, "CDM"), (10, "XLC"), (1, "IVX")):
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        digits.append(_pick(forms if power < 1000 else forms[:4], F.floor(n / power) % 10))
    return F.when(n.between(1, 3999), F.concat(*digits))


def from_roman(text: Column) -> Column:
    """The value of a Roman numeral (subtractive); null for anything else."""
    value = F.str_to_map(F.lit(",".join(f"{s}:{v}" for v, s in _ROMAN if len(s) == 1)))
    marks = F.transform(F.split(F.upper(text), ""), lambda c: value[c].cast("int"))
    last = F.struct(F.lit(0).alias("total"), F.lit(0).alias("right"))
    total = F.aggregate(
        F.reverse(marks), last, lambda s, v: F.struct((s["total"] + F.when(v < s["right"], -v).otherwise(v)).alias("total"), v.alias("right")), lambda s: s["total"]
    )
    return F.when(text.rlike("(?i)^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), total)


def grouped_digits(digits: Column) -> Column:
    """A run of digits read in groups: four as two and two, otherwise threes, where a last single
    digit joins the group before it as two and two. Groups are joined by a comma."""
    n = F.length(digits)
    lone = (n % 3 == 1) & (n > 4)
    body = F.when(lone, n - 4).otherwise(n)
    threes = F.transform(F.sequence(F.lit(1), F.greatest(body, F.lit(1)), F.lit(3)), lambda i: digits.substr(i, F.least(F.lit(3), body - i + 1)))
    tail = F.when(lone, F.array(digits.substr(n - 3, F.lit(2)), digits.substr(n - 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.when(n == 4, F.concat_ws(", ", digits.substr(1, 2), digits.substr(3, 2))).otherwise(F.array_join(F.concat(F.when(body > 0, threes).otherwise(F.array().cast("array<string>")), tail), ", "))


def spoken_group(group: Column) -> Column:
    """A group of at most three digits with its leading zeros spoken one by one."""
    zeros = F.length(F.regexp_extract(group, "^(0*)", 1))
    rest = F.regexp_replace(group, "^0+", "")
    said = F.when(rest == "", F.lit("")).otherwise(cardinal(rest.cast("long")))
    return F.trim(F.concat(F.repeat(F.lit("ноль "), zeros), said))


#: Years, months and clock words.
MONTHS_GEN = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()


def date_words(day: Column, month: Column, year: Column, case: str = "gen") -> Column:
    """An ordinal day in neuter, the month, and the year as a genitive ordinal; null outside the
    ranges 1..31 and 1..12 (ranges only, no calendar)."""
    ok = day.between(1, 31) & month.between(1, 12)
    return F.when(ok, F.concat_ws(" ", ordinal(day, case, "n"), _pick(MONTHS_GEN, month - 1), ordinal(year, "gen", "m"), F.lit("года")))


def time_words(hour: Column, minute: Column) -> Column:
    """Hours and minutes with their nouns; null outside 0..23 and 0..59."""
    ok = hour.between(0, 23) & minute.between(0, 59)
    return F.when(
        ok,
        F.concat_ws(" ", cardinal(hour), plural(hour, "час", "часа", "часов"), cardinal(minute, gender="f"), plural(minute, "минута", "минуты", "минут")),
    )


def money_words(cents: Column, major: tuple[str, str, str], minor: tuple[str, str, str], minor_gender: str = "f") -> Column:
    """An amount in hundredths as major and minor units in words."""
    whole, part = F.floor(F.abs(cents) / 100), F.abs(cents) % 100
    words = F.concat_ws(" ", cardinal(whole), plural(whole, *major), cardinal(part, gender=minor_gender), plural(part, *minor))
    return F.concat(F.when(cents < 0, "минус ").otherwise(""), words)


def digit_words(text: Column) -> Column:
    """Digits one by one."""
    names = ["ноль", *unit_words("nom")[1:10]]
    return F.array_join(F.transform(F.split(text, ""), lambda d: _pick(names, d)), " ")
