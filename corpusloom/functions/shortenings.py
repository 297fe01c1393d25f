"""Shortened nouns in the case that the words before them ask for.

``в гл. 5``, ``у оз. Нарочь``: the preposition gives the case, a number or a name behind the shortening says that it
is one. Without a preposition it is the nominative, after ``смотри`` or ``см.`` the accusative. Some nouns stand before
numbers, some before names, some before both. Forms come from the way a noun declines, so a noun is one
line of a table, and all forms are one constant map in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numerals as N
from .regexmap import regex_map

#: Singular endings by way of declining, in the order of ``numerals.CASES``.
_ENDINGS = {
    "а": ("а", "ы", "е", "у", "ой", "е"), "ка": ("а", "и", "е", "у", "ой", "е"), "ца": ("а", "ы", "е", "у", "ей", "е"), "ья": ("ья", "ьи", "ье", "ью", "ьёй", "ье"),
    "ь": ("ь", "и", "и", "ь", "ью", "и"), "": ("", "а", "у", "", "ом", "е"), "одуш": ("", "а", "у", "а", "ом", "е"), "о": ("о", "а", "у", "о", "ом", "е"), "ок": ("ок", "ка", "ку", "ок", "ком", "ке"),
}
#: Shortening: stem, way of declining, what follows (number, name or both).
NOUNS = {
    "гл": ("глав", "а", "number"), "рис": ("рисун", "ок", "number"), "табл": ("таблиц", "ца", "number"), "стр": ("страниц", "ца", "number"), "ст": ("стат", "ья", "number"),
    "п": ("пункт", "", "number"), "ч": ("част", "ь", "number"), "кн": ("книг", "ка", "number"), "разд": ("раздел", "", "number"), "вып": ("выпуск", "", "number"), "кв": ("квартир", "а", "number"),
    "каб": ("кабинет", "", "number"), "т": ("том", "", "number"), "ул": ("улиц", "ца", "name"), "пл": ("площад", "ь", "name"), "оз": ("озер", "о", "name"), "обл": ("област", "ь", "name"),
    "р": ("рек", "ка", "name"), "пос": ("посёл", "ок", "name"), "проф": ("профессор", "одуш", "name"), "акад": ("академик", "одуш", "name"), "ген": ("генерал", "одуш", "name"), "пр": ("проспект", "", "name"),
}
#: Which case a preposition asks for, of a place or a part.
PREPOSITIONS = {
    "gen": "без близ возле вокруг для до из из-за из-под кроме мимо около от после против среди у с со вместо вдоль", "dat": "к ко по согласно благодаря", "acc": "через про сквозь",
    "ins": "над под перед за между", "pre": "в во на о об при",
}


def forms(key: str) -> tuple[str, ...]:
    stem, way, _ = NOUNS[key]
    return tuple(stem + e for e in _ENDINGS[way])


def _table() -> Column:
    """The map of ``shortening:case`` to the form."""
    keys = [f"{k}:{c}" for k in NOUNS for c in N.CASES]
    words = [w for k in NOUNS for w in forms(k)]
    return F.map_from_arrays(F.split(F.lit("|".join(keys)), r"\|"), F.split(F.lit("|".join(words)), r"\|"))


def case_of(preposition: Column) -> Column:
    out = F.lit("nom")
    for case, words in PREPOSITIONS.items():
        out = F.when(preposition.isin(*words.split()), case).otherwise(out)
    return F.when(preposition.isin("см.", "смотри"), "acc").otherwise(out)


def noun_shortenings(text: Column) -> Column:
    table = _table()
    words = "|".join(sorted((w for ws in PREPOSITIONS.values() for w in ws.split()), key=lambda w: (-len(w), w)))
    for what, ahead in (("number", r"(?=(?:№\s?)?\d)"), ("name", r"(?=[«\"]?(?-i:\p{Lu}\p{Ll}))")):
        keys = "|".join(sorted((k for k, v in NOUNS.items() if v[2] == what), key=lambda k: (-len(k), k)))

        def say(m, before, short, *_):
            preposition = F.lower(F.trim(before))
            word = F.element_at(table, F.concat(F.lower(short), F.lit(":"), case_of(preposition)))
            # a form keeps a capital; "с" gets a vowel before two consonants
            shown = F.when(F.rlike(short, F.lit(r"^\p{Lu}")), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)
            lead = F.when((preposition == "с") & word.rlike("^с[^аеёиоуыэюя]"), F.regexp_replace(before, r"(?u)^(с|С)(\s+)$", "$1о$2")).otherwise(before)
            return F.concat(lead, shown, F.lit(" "))

        text = regex_map(text, rf"(?iu)(?<![\p{{L}}\d-])((?:(?:{words}|см\.|смотри)\s+)?)(?<![\p{{L}}\d])({keys})\.\s*{ahead}", 2, say)
    return text
