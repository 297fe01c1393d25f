"""Structured spans: a kind and a map of attributes give the text to be spoken, natively.

``say`` dispatches on the kind. Attributes are strings; blank ones count as missing, and a number
that can't be read counts as missing or stays as it is. A span that gives nothing is null, and the
caller keeps the original text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import letters as X
from . import numerals as N
from .regexmap import let, regex_map

# Fixed values of the language and of the span format: weekday 1 is Sunday, month 0 is January.
WEEKDAYS = "воскресенье понедельник вторник среда четверг пятница суббота".split()
MONTHS = "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь".split()

#: Units with a short form, which the unit rules inflect.
SHORT_UNITS = {
    "meter": "м", "kilometer": "км", "centimeter": "см", "millimeter": "мм", "gram": "г", "kilogram": "кг", "milligram": "мг", "ton": "т", "liter": "л", "milliliter": "мл",
    "second": "сек", "minute": "мин", "hour": "ч", "percent": "%", "celsius": "°C", "fahrenheit": "°F", "watt": "Вт", "kilowatt": "кВт", "volt": "В", "ampere": "А", "hertz": "Гц",
    "kilometer per hour": "км/ч", "meter per second": "м/с",
}
#: Units without one: forms for one, a few, many, and the gender.
LONG_UNITS = {
    "inch": ("дюйм", "дюйма", "дюймов", "m"), "foot": ("фут", "фута", "футов", "m"), "mile": ("миля", "мили", "миль", "f"), "yard": ("ярд", "ярда", "ярдов", "m"),
    "pound": ("фунт", "фунта", "фунтов", "m"), "ounce": ("унция", "унции", "унций", "f"), "day": ("день", "дня", "дней", "m"), "week": ("неделя", "недели", "недель", "f"),
    "month": ("месяц", "месяца", "месяцев", "m"), "year": ("год", "года", "лет", "m"), "byte": ("байт", "байта", "байт", "m"), "bit": ("бит", "бита", "бит", "m"), "step": ("шаг", "шага", "шагов", "m"),
}
#: Currencies: forms and gender of the whole unit, then of the hundredth where there is one.
CURRENCIES = {
    "RUB": ("рубль", "рубля", "рублей", "m", "копейка", "копейки", "копеек", "f"), "UAH": ("гривна", "гривны", "гривен", "f", "копейка", "копейки", "копеек", "f"),
    "BYN": ("белорусский рубль", "белорусских рубля", "белорусских рублей", "m", "копейка", "копейки", "копеек", "f"), "USD": ("доллар", "доллара", "долларов", "m", "цент", "цента", "центов", "m"),
    "EUR": ("евро", "евро", "евро", "m", "цент", "цента", "центов", "m"), "GBP": ("фунт", "фунта", "фунтов", "m", "пенс", "пенса", "пенсов", "m"),
    "CNY": ("юань", "юаня", "юаней", "m", "фэнь", "фэня", "фэней", "m"), "JPY": ("иена", "иены", "иен", "f"), "CHF": ("франк", "франка", "франков", "m", "сантим", "сантима", "сантимов", "m"),
}
_LONG_CASES = ["nominative", "genitive", "dative", "accusative", "instrumental", "locative"]
_LONG_GENDERS = {"male": "m", "female": "f", "neutral": "n"}
#: What a character of an address is called.
ADDRESS_SIGNS = {":": "двоеточие", "/": "слэш", ".": "точка", "?": "вопрос", "&": "амперсанд", "=": "равно", "-": "дефис", "_": "нижнее подчёркивание", "#": "решётка", "%": "процент", "+": "плюс", "@": "собака", "~": "тильда"}


def _rows(table: dict[str, tuple[str, ...]]) -> Column:
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,array<string>>")


def attribute(attrs: Column, name: str) -> Column:
    """A trimmed attribute; null where it is missing or blank."""
    return F.nullif(F.trim(attrs[name]), F.lit(""))


def number(attrs: Column, name: str) -> Column:
    return attribute(attrs, name).try_cast("long")


def spell(text: Column) -> Column:
    """Character by character: digits in words, letters and symbols by name, a space as a pause."""
    digits = dict(zip("0123456789", ["ноль", *N.unit_words("nom")[1:10]], strict=True))
    names = X._table(X.LATIN_NAMES | X.CYRILLIC_NAMES | digits | X.SYMBOL_NAMES)

    def one(c: Column) -> Column:
        return F.when(c.rlike(r"\s"), F.lit(",")).otherwise(F.coalesce(names[c], F.when(c.rlike(r"\p{L}"), c)))

    said = F.transform(F.split(F.lower(text), ""), one)
    joined = F.array_join(F.filter(said, lambda x: x.isNotNull()), " ")
    return F.regexp_replace(F.regexp_replace(joined, " ,", ","), r"^[,\s]+|[,\s]+$", "")


def spelled_address(address: Column) -> Column:
    """An address with its digits and separators by name and single letters by theirs."""
    digits = dict(zip("0123456789", ["ноль", *N.unit_words("nom")[1:10]], strict=True))
    names, letters = X._table(digits | ADDRESS_SIGNS), X._table(X.LATIN_NAMES)
    bare = F.regexp_replace(F.lower(address), r"^https?://", "")
    spaced = regex_map(bare, r"[0-9:/.?&=_#%+@~-]", 0, lambda m, *_: F.concat(F.lit(" "), names[m], F.lit(" ")))
    named = regex_map(spaced, r"(?<!\p{L})[a-z](?!\p{L})", 0, lambda m, *_: letters[m])
    return F.trim(F.regexp_replace(named, " {2,}", " "))


def electronic(attrs: Column) -> Column:
    """An address out of its parts; null without a domain. A user and a domain alone are a mailbox."""
    part = {k: attribute(attrs, k) for k in ("protocol", "username", "password", "domain", "port", "path", "query_string", "fragment_id")}
    mailbox = part["username"].isNotNull() & part["protocol"].isNull() & part["path"].isNull() & part["port"].isNull()

    def before(value: Column, mark: str) -> Column:
        return F.coalesce(F.concat(F.lit(mark), value), F.lit(""))

    user = F.coalesce(F.concat(part["username"], before(part["password"], ":"), F.lit("@")), F.lit(""))
    protocol = F.coalesce(F.concat(part["protocol"], F.lit("://")), F.lit(""))
    whole = F.concat(protocol, user, part["domain"], before(part["port"], ":"), before(F.regexp_replace(part["path"], "^/", ""), "/"), before(part["query_string"], "?"), before(part["fragment_id"], "#"))
    return F.when(mailbox, F.concat(part["username"], F.lit("@"), part["domain"])).otherwise(whole)


def time(attrs: Column) -> Column:
    """Hours, and minutes unless they are missing or zero."""
    h, m = number(attrs, "hours"), number(attrs, "minutes")
    hours = F.concat_ws(" ", N.cardinal(h), N.plural(h, "час", "часа", "часов"))
    minutes = F.when(F.coalesce(m, F.lit(0)) != 0, F.concat_ws(" ", N.cardinal(m, gender="f"), N.plural(m, "минута", "минуты", "минут")))
    return F.when(h.isNotNull(), F.concat_ws(" ", hours, minutes))


def date(attrs: Column) -> Column:
    """Weekday, day and month or either, year in the genitive, whichever are given and in range."""
    weekday, day, month, year = (number(attrs, k) for k in ("weekday", "day", "month", "year"))
    day, month = F.when(day.between(1, 31), day), F.when(month.between(0, 11), month)
    of_month = F.coalesce(N._pick(N.MONTHS_GEN, month), F.lit("число"))
    day_month = F.when(day.isNotNull(), F.concat_ws(" ", N.ordinal(day, "nom", "n"), of_month)).otherwise(N._pick(MONTHS, month))
    of_year = F.when(year.between(1, 999_999), F.concat_ws(" ", N.ordinal(year, "gen", "m"), F.lit("года")))
    rest = F.nullif(F.concat_ws(" ", day_month, of_year), F.lit(""))
    return F.nullif(F.concat_ws(", ", F.when(weekday.between(1, 7), N._pick(WEEKDAYS, weekday - 1)), rest), F.lit(""))


def ordinal(attrs: Column) -> Column:
    """The ordinal in the case and gender asked for (nominative, male by default); an accusative of
    something animate is the genitive. A number that isn't one from 1 to 999999 stays as it is."""
    n, case = number(attrs, "number"), F.coalesce(attribute(attrs, "case"), F.lit("nominative"))
    gender = F.coalesce(attribute(attrs, "gender"), F.lit("male"))
    case = F.when((case == "accusative") & (gender == "male") & (attribute(attrs, "animacy") == "animate"), "genitive").otherwise(case)
    # only the last word inflects: its ending is exchanged
    place = F.array_position(F.lit(list(_LONG_GENDERS)), gender) * 6 + F.array_position(F.lit(_LONG_CASES), case) - 7
    hard, third = ([e for g in _LONG_GENDERS.values() for e in endings[g]] for endings in (N._HARD, N._THIRD))

    def inflected(base: Column) -> Column:
        stem = base.substr(F.lit(1), F.length(base) - 2)
        return F.when((gender == "male") & case.isin("nominative", "accusative"), base).otherwise(F.concat(stem, F.when(base.endswith("третий"), N._pick(third, place)).otherwise(N._pick(hard, place))))

    return F.when(n.between(1, 999_999), let(N.ordinal(n), inflected)).otherwise(attribute(attrs, "number"))


def decimal(attrs: Column) -> Column:
    """``whole,part`` for the number rules; a missing whole is 0, a missing part leaves the whole."""
    whole, part = attribute(attrs, "integer_part"), attribute(attrs, "fractional_part")
    return F.when(part.isNull(), whole).otherwise(F.concat(F.coalesce(whole, F.lit("0")), F.lit(","), part))


def fraction(attrs: Column) -> Column:
    """``top/bottom`` for the fraction rule, after a whole number in words if there is one."""
    whole, top, bottom = (attribute(attrs, k) for k in ("integer_part", "numerator", "denominator"))
    n, slash = whole.try_cast("long"), F.concat(top, F.lit("/"), bottom)
    mixed = F.concat_ws(" ", N.cardinal(n, gender="f"), N.plural(n, "целая", "целых", "целых"), F.lit("и"), slash)
    return F.when(slash.isNull(), whole).when(F.coalesce(n, F.lit(0)) == 0, slash).otherwise(mixed)


def amount(attrs: Column) -> Column:
    """The number of a measure or a price: whole, decimal or fraction."""
    return F.coalesce(attribute(attrs, "number"), F.when(attribute(attrs, "numerator").isNull(), decimal(attrs)), fraction(attrs))


def counted(n: Column, forms: Column, gender: Column, at: int = 0) -> Column:
    """The number in words and the form that agrees, out of an array of forms from ``at``."""
    said = N.cardinal(n)
    feminine = F.regexp_replace(F.regexp_replace(said, "(^| )один$", "$1одна"), "(^| )два$", "$1две")
    return F.concat_ws(" ", F.when(gender == "f", feminine).otherwise(said), F.get(forms, N.plural_form(n) + at))


def unit_key(name: Column) -> Column:
    """A unit's name in the singular, with spaces between its words."""
    plain = F.trim(F.translate(F.lower(name), "-_", "  "))
    return F.when(plain == "feet", "foot").when(plain == "inches", "inch").otherwise(F.regexp_replace(plain, "s$", ""))


def measure(attrs: Column) -> Column:
    """A number and its unit: the short form where there is one, else in words that agree (the
    genitive singular after a decimal), else the unit as it was given."""

    def said(s: Column) -> Column:
        n, key = s["n"], s["k"]
        long, whole = _rows(LONG_UNITS)[key], n.try_cast("long")
        words = F.when(whole.isNull(), F.concat_ws(" ", n, long[1])).otherwise(counted(whole, long, long[3]))
        return F.when(n.isNull(), F.lit(None)).when(X._table(SHORT_UNITS)[key].isNotNull(), F.concat_ws(" ", n, X._table(SHORT_UNITS)[key])).when(long.isNotNull(), words).otherwise(F.concat_ws(" ", n, s["u"]))

    unit = attribute(attrs, "unit")
    return let(F.struct(amount(attrs).alias("n"), unit.alias("u"), unit_key(unit).alias("k")), said)


def money(attrs: Column) -> Column:
    """Whole units and hundredths in words. Without a hundredth, or with a whole that can't be read,
    the decimal and the genitive singular; an unknown currency keeps its code."""
    whole = F.coalesce(attribute(attrs, "integer_part"), attribute(attrs, "number"))
    part, code = attribute(attrs, "fractional_part"), F.upper(attribute(attrs, "currency"))
    shown = F.when(part.isNull(), whole).otherwise(F.concat(F.coalesce(whole, F.lit("0")), F.lit(","), part))

    def said(s: Column) -> Column:
        own, n = s["own"], s["whole"].try_cast("long")
        cents = F.substring(F.rpad(s["part"], 2, "0"), 1, 2).try_cast("long")
        major, minor = counted(n, own, own[3]), counted(cents, own, F.get(own, F.lit(7)), 4)
        some, plain = F.coalesce(cents, F.lit(0)) > 0, F.concat_ws(" ", s["shown"], own[1])
        known = F.when(n.isNull() | (some & (F.size(own) == 4)), plain).when(some, F.concat_ws(" ", major, minor)).otherwise(major)
        return F.when(s["shown"].isNull(), F.lit(None)).when(own.isNull(), F.concat_ws(" ", s["shown"], s["code"])).otherwise(known)

    return let(F.struct(whole.alias("whole"), part.alias("part"), shown.alias("shown"), code.alias("code"), _rows(CURRENCIES)[code].alias("own")), said)


def cut_digits(digits: Column) -> Column:
    """A run of digits as an array of groups: up to four as they are, else threes from the left after
    the odd rest, with two pairs at the end of seven or more."""
    n = F.length(digits)
    tail = F.when(n >= 7, 4).otherwise(0)
    head = n - tail
    first = head % 3
    nothing = F.array().cast("array<string>")
    start = F.when(first > 0, F.array(digits.substr(F.lit(1), first))).otherwise(nothing)
    threes = F.when(head >= 3, F.transform(F.sequence(first + 1, F.greatest(head - 2, first + 1), F.lit(3)), lambda i: digits.substr(i, F.lit(3)))).otherwise(nothing)
    pairs = F.when(tail > 0, F.array(digits.substr(n - 3, F.lit(2)), digits.substr(n - 1, F.lit(2)))).otherwise(nothing)
    return F.when(n <= 4, F.array(digits)).otherwise(F.concat(start, threes, pairs))


def spoken_digits(group: Column) -> Column:
    """A group with its leading zeros one by one and the rest as a number."""
    zeros = F.length(F.regexp_extract(group, "^(0*)", 1))
    rest = F.nullif(F.regexp_replace(group, "^0+", ""), F.lit(""))
    said = F.concat_ws(" ", F.nullif(F.rtrim(F.repeat(F.lit("ноль "), zeros)), F.lit("")), F.when(rest.isNotNull(), N.cardinal(rest.try_cast("long"))))
    return F.when(group.isNotNull(), said)


def telephone(attrs: Column) -> Column:
    """Country code after a plus, the groups, the extension; long groups are cut first."""
    groups = F.filter(F.split(attribute(attrs, "number_parts"), r"\D+"), lambda g: g != "")
    country, extension = (F.nullif(F.regexp_replace(attribute(attrs, k), r"\D", ""), F.lit("")) for k in ("country_code", "extension"))
    said = F.array_join(F.transform(F.flatten(F.transform(groups, cut_digits)), spoken_digits), ", ")
    return F.when(F.size(groups) > 0, F.concat_ws(", ", F.concat(F.lit("плюс "), spoken_digits(country)), said, F.concat(F.lit("добавочный "), spoken_digits(extension))))


def say(kind: Column, attrs: Column, lang: str = "ru") -> Column:
    """What a span of ``kind`` says; null for unknown kinds. Other languages than Russian only have
    text, cardinal and digits (one by one)."""
    plain = {"text": attribute(attrs, "text"), "cardinal": attribute(attrs, "number")}
    if lang != "ru":
        kinds = plain | {"digits": F.array_join(F.split(attribute(attrs, "digits"), ""), " ")}
    else:
        kinds = plain | {
            "ordinal": ordinal(attrs), "decimal": decimal(attrs), "fraction": fraction(attrs), "measure": measure(attrs), "time": time(attrs), "date": date(attrs), "telephone": telephone(attrs),
            "electronic": electronic(attrs), "money": money(attrs), "digits": spell(attribute(attrs, "digits")), "verbatim": spell(attribute(attrs, "verbatim")),
        }
    out = F.lit(None).cast("string")
    for name, said in kinds.items():
        out = F.when(kind == name, said).otherwise(out)
    return F.nullif(out, F.lit(""))
