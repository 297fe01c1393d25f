"""Rules for written notation: ordinal suffixes, years, ranges, scales, degrees, sections, signs,
abbreviations. Each takes and returns a text column; what can't be decided stays as it was."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numerals as N
from .regexmap import fold, regex_map
from .rules import UNITS, counted, noun_forms

#: Suffixes of ordinals: gender and case.
_SUFFIXES = {
    "й": ("m", "nom"), "ый": ("m", "nom"), "ой": ("m", "nom"), "я": ("f", "nom"), "ая": ("f", "nom"), "е": ("n", "nom"), "ое": ("n", "nom"),
    "го": ("m", "gen"), "ого": ("m", "gen"), "му": ("m", "dat"), "ому": ("m", "dat"), "м": ("m", "pre"), "ом": ("m", "pre"), "ым": ("m", "ins"), "ую": ("f", "acc"), "ю": ("f", "acc"),
}


def ordinal_suffixes(text: Column) -> Column:
    """``5-й``, ``3-я``, ``20-го``."""

    def say(m, digits, suffix, *_):
        n, out = digits.cast("long"), F.lit(None).cast("string")
        for gender, case in sorted(set(_SUFFIXES.values())):
            out = F.when(F.lower(suffix).isin(*[s for s, k in _SUFFIXES.items() if k == (gender, case)]), N.ordinal(n, case, gender)).otherwise(out)
        return out

    names = "|".join(sorted(_SUFFIXES, key=len, reverse=True))
    return regex_map(text, rf"(?iu)(?<![\d.,\p{{L}}])(\d{{1,6}})-({names})(?!\p{{L}})", 2, say)


def case_suffixes(text: Column) -> Column:
    """``5-ти``, ``3-х``, ``7-мя``: the case that the suffix shows."""

    def say(m, digits, suffix, *_):
        n, low = digits.cast("long"), F.lower(suffix)
        return F.when(low.isin("мя", "ью"), N.cardinal(n, "ins")).when(low.isin("ти", "и", "х", "ёх", "ех"), N.cardinal(n, "gen")).when(low.isin("ём", "ем"), N.cardinal(n, "dat"))

    return regex_map(text, r"(?iu)(?<![\d.,\p{L}])(\d{1,6})-(мя|ью|ти|и|х|ёх|ех|ём|ем)(?!\p{L})", 2, say)


_YEAR_NOUNS = {"год": "nom", "года": "gen", "году": "dat", "годом": "ins", "годе": "pre"}


def years(text: Column) -> Column:
    """A four-digit number before a form of the word for year; ``г.`` is a year too, locative after
    «в». The dative form after «в» is the locative."""

    def say(m, word, digits, noun, *_):
        n, low, inside = digits.cast("long"), F.lower(noun), F.lower(F.trim(word)) == "в"
        out = F.lit(None).cast("string")
        for form, case in _YEAR_NOUNS.items():
            said = N.ordinal(n, case) if case != "dat" else F.when(inside, N.ordinal(n, "pre")).otherwise(N.ordinal(n, "dat"))
            out = F.when(low == form, F.concat(word, said, F.lit(" "), noun)).otherwise(out)
        short = F.when(inside, F.concat(word, N.ordinal(n, "pre"), F.lit(" году"))).otherwise(F.concat(word, N.ordinal(n), F.lit(" год")))
        return F.when(low == "г.", short).otherwise(out)

    return regex_map(text, r"(?iu)((?<!\p{L})в )?(?<![\d.,-])([1-2]\d{3}) (год(?:а|у|ом|е)?(?!\p{L})|г\.)", 3, say)


def day_ranges(text: Column) -> Column:
    """``3-15 мая``: from the one to the other; both days in range and rising."""

    def say(m, a, b, month, *_):
        x, y = a.cast("int"), b.cast("int")
        return F.when((x >= 1) & (x < y) & (y <= 31), F.concat_ws(" ", F.lit("с"), N.ordinal(x, "gen", "n"), F.lit("по"), N.ordinal(y, "acc", "n"), month))

    return regex_map(text, rf"(?iu)(?<![\d.])(\d{{1,2}})[-–—](\d{{1,2}}) ({'|'.join(N.MONTHS_GEN)})(?!\p{{L}})", 3, say)


def day_month(text: Column) -> Column:
    def say(m, d, month, *_):
        return F.when(d.cast("int").between(1, 31), F.concat_ws(" ", N.ordinal(d.cast("int"), "gen", "n"), month))

    return regex_map(text, rf"(?iu)(?<![\d.,-])(\d{{1,2}}) ({'|'.join(N.MONTHS_GEN)})(?!\p{{L}})", 2, say)


def page_ranges(text: Column) -> Column:
    def say(m, a, b, *_):
        return F.concat_ws(" ", F.lit("страницы с"), N.ordinal(a.cast("long"), "gen", "f"), F.lit("по"), N.ordinal(b.cast("long"), "acc", "f"))

    return regex_map(text, r"(?iu)(?<!\p{L})стр\.\s?(\d{1,4})[-–—](\d{1,4})(?!\d)", 2, say)


def unit_ranges(text: Column) -> Column:
    """``от 5 до 7 км``: both numbers and the unit in the genitive."""

    def say(m, a, b, unit, *_):
        own = noun_forms(UNITS, unit)
        said = [F.when(own[3] == "f", N.cardinal(x.cast("long"), "gen", "f")).otherwise(N.cardinal(x.cast("long"), "gen")) for x in (a, b)]
        return F.when(own.isNotNull(), F.concat_ws(" ", F.lit("от"), said[0], F.lit("до"), said[1], own[2]))

    names = "|".join(sorted(UNITS, key=len, reverse=True))
    return regex_map(text, rf"(?iu)(?<!\p{{L}})от (\d{{1,9}}) до (\d{{1,9}})\s?({names})(?!\p{{L}})\.?", 3, say)


#: Scale abbreviations: forms for one, a few, many, and the numeral's gender.
_SCALES = {"тыс": ("тысяча", "тысячи", "тысяч", "f"), "млн": ("миллион", "миллиона", "миллионов", "m"), "млрд": ("миллиард", "миллиарда", "миллиардов", "m"), "трлн": ("триллион", "триллиона", "триллионов", "m")}


def half_scales(text: Column) -> Column:
    """``2,5 млн`` with a half; one and a half has a word of its own; not after a final one."""

    def say(m, whole, scale, *_):
        n, own = whole.cast("long"), noun_forms(_SCALES, scale)
        feminine = own[3] == "f"
        number = F.when(feminine, N.cardinal(n, gender="f")).otherwise(N.cardinal(n))
        half = F.concat(F.when(feminine, "полторы ").otherwise("полтора "), own[1])
        return F.when(n == 1, half).when((n > 1) & (n % 10 != 1), F.concat(number, F.lit(" с половиной "), F.when(N.plural_form(n) == 2, own[2]).otherwise(own[1])))

    return regex_map(text, rf"(?iu)(?<![\d.,])(\d{{1,3}}),5\s?({'|'.join(_SCALES)})(?!\p{{L}})\.?", 2, say)


def scales(text: Column) -> Column:
    """``5 тыс.``, ``3,2 млрд``: agreement, or the genitive singular after a fraction."""

    def say(m, whole, digits, scale, *_):
        n, own = whole.cast("long"), noun_forms(_SCALES, scale)
        return F.when(digits == "", counted(_SCALES, n, scale)).otherwise(F.concat(N.decimal_words(n, digits), F.lit(" "), own[1]))

    return regex_map(text, rf"(?iu)(?<![\d.,])(\d{{1,9}})(?:,(\d{{1,4}}))?\s?({'|'.join(_SCALES)})(?!\p{{L}})\.?", 3, say)


def degrees(text: Column) -> Column:
    def say(m, sign, digits, scale, *_):
        n = digits.cast("long")
        named = F.when(F.upper(scale) == "C", " Цельсия").when(F.upper(scale) == "F", " Фаренгейта").otherwise("")
        return F.concat(F.when(sign == "", "").when(sign == "+", "плюс ").otherwise("минус "), N.cardinal(n), F.lit(" "), N.plural(n, "градус", "градуса", "градусов"), named)

    return regex_map(text, r"(?u)(?<![\d.,\p{L}])([+−-]?)(\d{1,4})\s?°\s?([CFСc]?)(?!\p{L})", 3, say)


def number_signs(text: Column) -> Column:
    text = regex_map(text, r"№\s?(\d{1,12})(?!\d)", 1, lambda m, n, *_: F.concat(F.lit("номер "), N.cardinal(n.cast("long"))))
    return regex_map(text, r"§\s?(\d{1,6})(?!\d)", 1, lambda m, n, *_: F.concat(F.lit("параграф "), N.cardinal(n.cast("long"))))


def section_numbers(text: Column) -> Column:
    """Three or more dotted parts, each spoken, leading zeros one by one."""
    return regex_map(text, r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){2,}(?![\d.]*\d)", 0, lambda m, *_: F.array_join(F.transform(F.split(m, r"\."), lambda p: N.spoken_group(p)), " точка "))


def dimensions(text: Column) -> Column:
    return regex_map(text, r"(?u)(?<![\d.,])(\d{1,6})\s?[xх×]\s?(\d{1,6})(?![\d.,])", 2, lambda m, a, b, *_: F.concat_ws(" на ", N.cardinal(a.cast("long")), N.cardinal(b.cast("long"))))


def powers(text: Column) -> Column:
    return regex_map(text, r"(?<![\d.,])(\d{1,9})([²³])", 2, lambda m, n, p, *_: F.concat(N.cardinal(n.cast("long")), F.when(p == "²", " в квадрате").otherwise(" в кубе")))


def arithmetic(text: Column) -> Column:
    """Signs between numbers; a dash without spaces is a range and stays."""
    return fold(
        text, (r"(?<=\d) ?\+ ?(?=\d)", " плюс "), (r"(?<=\d) − ?(?=\d)", " минус "), (r"(?<=\d) [-–] (?=\d+ ?=)", " минус "), (r"(?<=\d) ?[·×*] ?(?=\d)", " умножить на "),
        (r"(?<=\d) ?÷ ?(?=\d)", " разделить на "), (r"(?<=[\d)]) ?= ?(?=[-\d])", " равно "), (r" ?≥ ?(?=\d)", " больше или равно "), (r" ?≤ ?(?=\d)", " меньше или равно "), (r"(?<=\d) ?> ?(?=\d)", " больше "), (r"(?<=\d) ?< ?(?=\d)", " меньше "),
    )


def signs_before_numbers(text: Column) -> Column:
    """A minus or tilde before a number, not between numbers."""
    return fold(text, (r"(?<![\d\p{L}.,)])[-−](?=\d)", "минус "), (r"(?<!\d)~\s?(?=\d)", "примерно "), (r"(?<![\d\p{L}])±\s?(?=\d)", "плюс-минус "))


#: Fixed abbreviations that need no context.
_FIXED = (
    (r"и т\. ?д\.", "и так далее"), (r"и т\. ?п\.", "и тому подобное"), (r"т\. ?е\.", "то есть"), (r"т\. ?к\.", "так как"), (r"т\. ?н\.", "так называемый"),
    (r"и др\.", "и другие"), (r"и пр\.", "и прочее"), (r"до н\. ?э\.", "до нашей эры"), (r"н\. ?э\.", "нашей эры"), (r"см\.", "смотри"), (r"напр\.", "например"),
)


def abbreviations(text: Column) -> Column:
    text = fold(text, *[(rf"(?iu)(?<!\p{{L}}){pattern}", words) for pattern, words in _FIXED])
    return fold(text, (r"(?u)(?<!\p{L})г\. (?=\p{Lu}\p{Ll})", "город "), (r"(?u)(?<!\p{L})ул\. (?=\p{Lu})", "улица "), (r"(?u)(?<!\p{L})обл\.", "область"))


def spoons(text: Column) -> Column:
    def say(m, digits, kind, *_):
        n = digits.cast("long")
        one, many = F.when(kind == "ст", "столовая").otherwise("чайная"), F.when(kind == "ст", "столовых").otherwise("чайных")
        few = F.when(kind == "ст", "столовые").otherwise("чайные")
        form = N.plural_form(n)
        return F.concat_ws(" ", N.cardinal(n, gender="f"), F.when(form == 0, one).when(form == 1, few).otherwise(many), N.plural(n, "ложка", "ложки", "ложек"))

    return regex_map(text, r"(?u)(?<![\d.,])(\d{1,3})\s?(ст|ч)\. ?л\.", 2, say)


def requisites(text: Column) -> Column:
    """Long numbers after a label, and codes after a trigger word, in groups."""

    def say(m, label, digits, *_):
        groups = F.transform(F.split(N.grouped_digits(digits), ", "), lambda g: N.spoken_group(g))
        return F.concat(label, F.lit(" "), F.array_join(groups, ", "))

    return regex_map(text, r"(?iu)(?<!\p{L})(ИНН|КПП|ОГРН|БИК|СНИЛС|код|пин|пароль) (\d{4,20})(?!\d)", 2, say)
