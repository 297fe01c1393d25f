"""Single-step text rules as column expressions, and the switchable chain that orders them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numerals as N
from .regexmap import fold, let, regex_map

_URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"']+"


def has_url(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("http") | low.contains("www.") | text.contains("@")


def outside_urls(text: Column, change: Callable[[Column], Column]) -> Column:
    """Applies ``change`` between URLs only."""

    def parts(t: Column) -> Column:
        between, found = F.split(t, _URL, -1), F.regexp_extract_all(t, F.lit(_URL), F.lit(0))
        glued = F.zip_with(F.transform(between, change), F.concat(found, F.array(F.lit(""))), lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
        return F.when(has_url(t), F.array_join(glued, "")).otherwise(change(t))

    return let(text, parts)


def punctuation(text: Column) -> Column:
    """Repeated marks, ellipsis, arrows, rule lines, missing spaces after marks."""
    return fold(
        text,
        (r"[ \t\u00a0]+", " "),
        (r"\.{3,}", "…"),
        (r"([!?])\1+", "$1"),
        (r",{2,}", ","),
        (r"\s*(?:->|=>|→)\s*", " — "),
        (r"(?m)^[-=_*~]{3,}$", ""),
        (r"(?<=\p{L}) - (?=\p{L})", " — "),
        (r"([,;!?])(?=\p{L})", "$1 "),
    )


def footnotes(text: Column) -> Column:
    """Drops bracketed and superscript note numbers."""
    return fold(text, (r"(?<=[\p{L}.,;!?»\"])\[\d{1,3}\]", ""), (r"(?<=\p{L})[⁰¹²³⁴⁵⁶⁷⁸⁹]+", ""))


def thousands(text: Column) -> Column:
    """Glues digit groups: no-break spaces always; plain spaces where two groups follow or the
    group is 000; dots where two groups follow."""
    text = regex_map(text, r"\b\d{1,3}(?:[\u00a0\u202f\u2009]\d{3})+\b", 0, lambda m, *_: F.regexp_replace(m, r"[^\d]", ""))
    text = regex_map(text, r"(?<![\d.,])\d{1,3}(?:(?: \d{3}){2,}| 000)(?!\d)", 0, lambda m, *_: F.regexp_replace(m, " ", ""))
    return regex_map(text, r"(?<![\d.,])\d{1,3}(?:\.\d{3}){2,}(?![\d.])", 0, lambda m, *_: F.regexp_replace(m, r"\.", ""))


def percents(text: Column) -> Column:
    def say(m, whole, digits, *_):
        n = whole.cast("long")
        return F.when(digits == "", F.concat_ws(" ", N.cardinal(n), N.plural(n, "процент", "процента", "процентов"))).otherwise(F.concat(N.decimal_words(n, digits), F.lit(" процента")))

    return regex_map(text, r"(?<![\d.,])(\d{1,12})(?:[.,](\d{1,4}))?\s?%", 2, say)


def decimals(text: Column) -> Column:
    return regex_map(text, r"(?<![\d.,])(\d{1,12})[.,](\d{1,4})(?![\d.,]|\p{L})", 2, lambda m, whole, digits, *_: N.decimal_words(whole.cast("long"), digits))


def fractions(text: Column) -> Column:
    """``3/4``: feminine cardinal and ordinal denominator."""

    def say(m, top, bottom, *_):
        n, d = top.cast("long"), bottom.cast("long")
        one = N.ordinal(d, "nom", "f")
        many = F.regexp_replace(N.ordinal(d, "gen", "m"), "ого$", "ых")
        return F.when((n > 0) & (d > 1), F.concat_ws(" ", N.cardinal(n, gender="f"), F.when(N.plural_form(n) == 0, one).otherwise(F.regexp_replace(many, "ьего$", "ьих"))))

    return regex_map(text, r"(?<![\d/.])(\d{1,3})/(\d{1,3})(?![\d/])", 2, say)


#: Prepositions with one case each.
_CASE_OF = {"около": "gen", "до": "gen", "от": "gen", "без": "gen", "более": "gen", "менее": "gen", "к": "dat", "между": "ins"}


def cases(text: Column) -> Column:
    """A bare number after a preposition takes the preposition's case."""

    def say(m, word, digits, *_):
        n = digits.cast("long")
        by_case = F.lit(None).cast("string")
        for case in ("gen", "dat", "ins"):
            names = [w for w, c in _CASE_OF.items() if c == case]
            by_case = F.when(F.lower(word).isin(*names), N.cardinal(n, case)).otherwise(by_case)
        return F.concat(word, F.lit(" "), by_case)

    return regex_map(text, rf"(?iu)(?<!\p{{L}})({'|'.join(_CASE_OF)}) (\d{{1,12}})(?![\d.,:/%-]|\s?\p{{L}}+\.)", 2, say)


def dates(text: Column) -> Column:
    """``dd.mm.yyyy`` and ISO dates; the day in the genitive, in the dative after «к»."""

    def say(before: Column, d: Column, m: Column, y: Column) -> Column:
        day, month, year = d.cast("int"), m.cast("int"), y.cast("int")
        said = F.when(F.lower(F.trim(before)) == "к", N.date_words(day, month, year, "dat")).otherwise(N.date_words(day, month, year))
        return F.concat(before, said)

    text = regex_map(text, r"(?iu)((?<!\p{L})к )?(?<![\d.])(\d{1,2})\.(\d{1,2})\.(\d{4})(?![\d.])", 4, lambda m, p, d, mo, y, *_: say(p, d, mo, y))
    return regex_map(text, r"(?<![\d-])(\d{4})-(\d{2})-(\d{2})(?![\d-])", 3, lambda m, y, mo, d, *_: say(F.lit(""), d, mo, y))


def times(text: Column) -> Column:
    return regex_map(text, r"(?<![\d:])(\d{1,2}):(\d{2})(?![\d:])", 2, lambda m, h, mi, *_: N.time_words(h.cast("int"), mi.cast("int")))


#: Units: forms for one, a few, many, and the numeral's gender.
UNITS = {
    "км": ("километр", "километра", "километров", "m"), "м": ("метр", "метра", "метров", "m"), "см": ("сантиметр", "сантиметра", "сантиметров", "m"),
    "мм": ("миллиметр", "миллиметра", "миллиметров", "m"), "кг": ("килограмм", "килограмма", "килограммов", "m"), "г": ("грамм", "грамма", "граммов", "m"),
    "т": ("тонна", "тонны", "тонн", "f"), "л": ("литр", "литра", "литров", "m"), "мл": ("миллилитр", "миллилитра", "миллилитров", "m"),
    "мин": ("минута", "минуты", "минут", "f"), "сек": ("секунда", "секунды", "секунд", "f"), "ч": ("час", "часа", "часов", "m"),
}
MONEY = {
    "руб": ("рубль", "рубля", "рублей", "m"), "₽": ("рубль", "рубля", "рублей", "m"), "коп": ("копейка", "копейки", "копеек", "f"),
    "$": ("доллар", "доллара", "долларов", "m"), "€": ("евро", "евро", "евро", "m"),
}


def noun_forms(table: dict[str, tuple[str, str, str, str]], key: Column) -> Column:
    """Forms for one, a few and many, and the gender, of the noun that ``key`` names, out of one
    constant table; null for others."""
    lines = F.from_json(F.lit(json.dumps({k: "|".join(v) for k, v in table.items()}, ensure_ascii=False)), "map<string,string>")
    return F.split(lines[F.lower(key)], r"\|")


def counted(table: dict[str, tuple[str, str, str, str]], n: Column, key: Column) -> Column:
    """The number and the form of the noun that ``key`` names; null for others."""
    own = noun_forms(table, key)
    number = F.when(own[3] == "f", N.cardinal(n, gender="f")).otherwise(N.cardinal(n)) if any(v[3] == "f" for v in table.values()) else N.cardinal(n)
    return F.when(own.isNotNull(), F.concat_ws(" ", number, F.get(own, N.plural_form(n))))


def units(text: Column) -> Column:
    names = "|".join(sorted(UNITS, key=len, reverse=True))
    return regex_map(text, rf"(?iu)(?<![\d.,])(\d{{1,12}})\s?({names})(?![\p{{L}}\d])\.?(?!\p{{L}})", 2, lambda m, n, u, *_: counted(UNITS, n.cast("long"), u))


def money(text: Column) -> Column:
    text = regex_map(text, r"([$€₽])\s?(\d{1,12})(?![\d.,])", 2, lambda m, s, n, *_: counted(MONEY, n.cast("long"), s))
    return regex_map(text, r"(?iu)(?<![\d.,])(\d{1,12})\s?(руб|коп|[$€₽])(?!\p{L})\.?", 2, lambda m, n, s, *_: counted(MONEY, n.cast("long"), s))


def roman(text: Column) -> Column:
    """Centuries: a Roman numeral before the word for century, in that word's case."""

    def say(m, digits, noun, *_):
        n = N.from_roman(digits)
        case = {"век": "nom", "века": "gen", "веку": "dat", "веком": "ins", "веке": "pre"}
        out = F.lit(None).cast("string")
        for form, c in case.items():
            out = F.when(F.lower(noun) == form, F.concat(N.ordinal(n, c), F.lit(" "), noun)).otherwise(out)
        return out

    return regex_map(text, r"(?u)(?<![\p{L}\p{N}])([IVX]{1,6}) (век(?:а|у|ом|е)?)(?!\p{L})", 2, say)


def phones(text: Column) -> Column:
    """``+7`` numbers of eleven digits, read group by group with their leading zeros."""

    def say(m, country, a, b, c, d, *_):
        return F.concat(F.lit("плюс "), F.concat_ws(", ", N.cardinal(country.cast("long")), *[N.spoken_group(x) for x in (a, b, c, d)]))

    return regex_map(text, r"(?<!\d)\+(7)[ -]?\(?(\d{3})\)?[ -]?(\d{3})[ -]?(\d{2})[ -]?(\d{2})(?!\d)", 5, say)


def whole_numbers(text: Column) -> Column:
    """What is left: up to twelve digits as a number, more digit by digit."""
    return regex_map(text, r"(?<!\p{L})(\d+)(?!\p{L})", 1, lambda m, n, *_: F.when(F.length(n) > 12, N.digit_words(n)).otherwise(N.cardinal(n.cast("long"))))


#: Letters that look alike in both scripts.
_LATIN_TWINS, _CYRILLIC_TWINS = "ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху"


def homoglyphs(text: Column) -> Column:
    """Words that mix scripts take the script of their letters that look like no other; without
    such letters, or with some of both, that of most letters."""

    def mend(m, *_):
        own_latin = F.length(F.regexp_replace(m, f"[^A-Za-z]|[{_LATIN_TWINS}]", ""))
        own_cyrillic = F.length(F.regexp_replace(m, f"[^А-Яа-яЁё]|[{_CYRILLIC_TWINS}]", ""))
        latin, cyrillic = F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.length(F.regexp_replace(m, "[^А-Яа-яЁё]", ""))
        clear = (own_latin > 0) != (own_cyrillic > 0)
        return F.when(F.when(clear, own_cyrillic > 0).otherwise(cyrillic >= latin), F.translate(m, _LATIN_TWINS, _CYRILLIC_TWINS)).otherwise(F.translate(m, _CYRILLIC_TWINS, _LATIN_TWINS))

    return regex_map(text, r"(?=\p{L}*[A-Za-z])(?=\p{L}*[А-Яа-яЁё])(?<!\p{L})\p{L}+", 0, mend)


_DIGRAPHS = (("shch", "щ"), ("sch", "ш"), ("sh", "ш"), ("ch", "ч"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("th", "т"), ("ph", "ф"), ("ck", "к"), ("qu", "кв"), ("oo", "у"), ("ee", "и"), ("yu", "ю"), ("ya", "я"))


def transliterate(text: Column) -> Column:
    """Latin words in Cyrillic letters: digraphs first, soft c and g, then letter by letter."""

    def one(m, *_):
        low = F.lower(m)
        for latin, cyrillic in _DIGRAPHS:
            low = F.regexp_replace(low, latin, cyrillic)
        low = fold(low, (r"c(?=[eiy])", "с"), (r"g(?=[eiy])", "дж"), (r"(?<=[a-zа-я]{2})e$", ""), (r"x", "кс"), (r"([bcdfgklmnprstvz])\1", "$1"))
        return F.translate(low, "abcdefghijklmnopqrstuvwyz", "абкдефгхижклмнопкрстуввиз")

    return regex_map(text, r"[A-Za-z]+", 0, one)


def letters_only(text: Column, allowed: str) -> Column:
    """Drops what an alphabet lacks and tidies spaces and commas."""
    kept = F.regexp_replace(text, rf"[^{allowed}]+", " ")
    return F.trim(fold(kept, (r"\s+([,.!?;:])", "$1"), (r",{2,}", ","), (r" {2,}", " ")))


_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "mdash": "—", "ndash": "–", "hellip": "…", "laquo": "«", "raquo": "»", "shy": ""}


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities; unknown ones stay."""
    names = F.from_json(F.lit(json.dumps(_ENTITIES)), "map<string,string>")

    def one(m, name, *_):
        digits = F.regexp_extract(name, r"^#(\d+)$", 1)
        hexes = F.regexp_extract(name, r"^#[xX]([0-9A-Fa-f]+)$", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(F.lower(name).rlike("^#"), F.when(code.between(1, 0x10FFFF), wide)).otherwise(names[name])

    return regex_map(text, r"&(#?[A-Za-z0-9]+);", 1, one)


def strip_markup(html: Column) -> Column:
    """Readable text: scripts and styles go, block ends become line ends, tags go, entities are
    decoded, spaces are tidied."""
    body = fold(
        html,
        (r"(?is)<(script|style|head)\b.*?</\1\s*>", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|title|section|article)\s*>", "\n"),
        (r"(?s)<[^>]*>", ""),
    )
    return fold(decode_entities(body), (r"[ \t\u00a0]+", " "), (r" ?\n ?", "\n"), (r"\n{2,}", "\n"), (r"^\s+|\s+$", ""))


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/?#:]+)", 1)


def links(text: Column, mode: str = "host") -> Column:
    """URLs shortened to their host, dropped, or kept."""
    if mode == "keep":
        return text
    shown = (lambda m, *_: url_host(m)) if mode == "host" else (lambda m, *_: F.lit(""))
    return let(text, lambda t: F.when(has_url(t), regex_map(t, _URL, 0, shown)).otherwise(t))


def _chain() -> list[tuple[str, Callable[[Column], Column], bool]]:
    """The chain: key, rule, on by default. The order is part of the contract: phones before
    thousands, degrees before Roman numerals, money before units, half scales before cases, cases
    before scales, days of a month before bare numbers."""
    from . import letters as L
    from . import marks as M
    from . import notation as W

    return [
        ("link_domain", links, True),
        ("drop_images", lambda t: M.image_marks(t, drop=True), False),
        ("punct", lambda t: outside_urls(t, punctuation), True),
        ("symbol_pauses", M.symbol_pauses, True),
        ("emoji", L.emoji_names, True),
        ("smileys", L.smiley_names, True),
        ("phones", phones, True),
        ("codes", W.requisites, True),
        ("signs", W.signs_before_numbers, True),
        ("thousands", thousands, True),
        ("footnotes", footnotes, True),
        ("degrees", W.degrees, True),
        ("centuries", M.arabic_centuries, True),
        ("roman", roman, True),
        ("cyrillic_codes", L.codes, True),
        ("dates", dates, True),
        ("times", times, True),
        ("years", W.years, True),
        ("suffixes", W.ordinal_suffixes, True),
        ("gen_suffix", W.case_suffixes, True),
        ("dimensions", W.dimensions, True),
        ("arith", W.arithmetic, True),
        ("powers", W.powers, True),
        ("spoons", W.spoons, True),
        ("unit_ranges", W.unit_ranges, True),
        ("money", money, True),
        ("units", units, True),
        ("fractions", fractions, True),
        ("page_ranges", W.page_ranges, True),
        ("abbrev", W.abbreviations, True),
        ("number_signs", W.number_signs, True),
        ("day_ranges", W.day_ranges, True),
        ("sections", W.section_numbers, True),
        ("half_scales", W.half_scales, True),
        ("cases", cases, True),
        ("scales", W.scales, True),
        ("day_month", W.day_month, True),
        ("percents", percents, True),
        ("decimals", decimals, True),
        ("letter_digit", L.letters_beside_digits, True),
        ("numbers", whole_numbers, True),
        ("first_pl", M.feminine_accusative, True),
        ("about", M.before_vowel_numerals, True),
        ("camel", L.camel_case, True),
        ("homoglyphs", homoglyphs, True),
        ("spell", L.acronyms, False),
        ("latin", transliterate, False),
        ("symbol_names", L.symbol_names, False),
        ("pause_parens", L.pauses_for_parentheses, False),
    ]


_DIGIT, _CYRILLIC = "[0-9]", "[\\x{0400}-\\x{052F}\\x{1C80}-\\x{1C8F}\\x{2DE0}-\\x{2DFF}\\x{A640}-\\x{A69F}]"

#: What every match of a rule holds. A text without it stays as it is, and one quick look replaces the
#: rule's search at each place.
_NEEDS = {"footnotes": "[0-9⁰¹²³⁴⁵⁶⁷⁸⁹]", "arith": "[0-9=]"} | dict.fromkeys(("roman", "abbrev", "first_pl", "about", "homoglyphs"), _CYRILLIC) | dict.fromkeys(
    (
        "phones", "codes", "signs", "thousands", "degrees", "centuries", "cyrillic_codes", "dates", "times", "years", "suffixes", "gen_suffix", "dimensions", "powers", "spoons",
        "unit_ranges", "money", "units", "fractions", "page_ranges", "number_signs", "day_ranges", "sections", "half_scales", "cases", "scales", "day_month", "percents", "decimals",
        "letter_digit", "numbers",
    ),
    _DIGIT,
)


def where_needed(key: str, rule: Callable[[Column], Column], text: Column) -> Column:
    """The rule ``key`` of the chain, tried only on texts that hold what it needs."""
    if key not in _NEEDS:
        return rule(text)
    return let(text, lambda t: F.when(t.rlike(_NEEDS[key]), rule(t)).otherwise(t))


@dataclass(frozen=True)
class Switches:
    """Rule switches, resolved when the plan is built: a rule that is off adds nothing to it."""

    changed: frozenset[str] = field(default_factory=frozenset)

    def on(self, key: str) -> bool:
        return next(default for k, _, default in _chain() if k == key) != (key in self.changed)

    def flipped(self, key: str) -> Switches:
        return replace(self, changed=self.changed ^ {key})


def normalise(df: DataFrame, column: str = "text", switches: Switches = Switches()) -> DataFrame:
    """The whole chain over one column, one projection per rule that is on; null stays null."""
    for key, rule, default in _chain():
        if default != (key in switches.changed):
            df = df.withColumn(column, where_needed(key, rule, F.col(column)))
    return df


def normalise_distinct(df: DataFrame, column: str = "text", switches: Switches = Switches()) -> DataFrame:
    """``normalise`` for columns that repeat their texts: every different text goes through the chain once and is
    joined back to its rows."""
    made = normalise(df.select(F.col(column).alias("_given")).distinct().withColumn("_made", F.col("_given")), "_made", switches)
    return df.join(made, F.col(column) == F.col("_given"), "left").drop(column, "_given").withColumnRenamed("_made", column)
