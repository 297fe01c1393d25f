"""Predicates over a text and small rewrites of marks, stresses and particles, as column expressions.
Null gives null; an empty text is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numerals as N
from .regexmap import fold, regex_map

_VOWELS = "аеёиоуыэюя"


def may_grow(text: Column) -> Column:
    """Whether spoken words may be longer than the text: digits, Latin letters, symbols, high code points."""
    return text.rlike(r"[0-9A-Za-z#$%&*+/<=>@^_|~№§°\x{2000}-\x{2BFF}\x{10000}-\x{10FFFF}]")


def is_ssml(text: Column) -> Column:
    """Whether the text is a speech markup document (it begins with its root or an XML header)."""
    start = F.lower(F.regexp_replace(text, r"^[\s\x{FEFF}]+", ""))
    return start.startswith("<speak") | start.startswith("<?xml")


def is_noise(text: Column) -> Column:
    """Whether a piece holds nothing to say: no letter and no digit."""
    return ~text.rlike(r"[\p{L}\p{N}]")


def symbol_pauses(text: Column) -> Column:
    """Middle dots and arrows between words become a pause."""
    return fold(text, (r"\s*[·•]\s*", ", "), (r"\s*(?:[←↑→↓]|[-=]>)\s*", " — "))


def image_marks(text: Column, drop: bool = False, name: str = "иллюстрация") -> Column:
    """A reader's image tag is named or dropped."""
    return fold(text, (r"(?i)\[(?:image|img|рисунок)[^\]\n]*\]", "" if drop else f" {name}. "), (r" {2,}", " "))


def blanked_markers(text: Column) -> Column:
    """Control markers in braces as blanks of the same length, so that offsets stay."""
    return regex_map(text, r"\{(?:skip|pause:\d+|prosody:[\d.]*:?[\d.]*)\}", 0, lambda m, *_: F.repeat(F.lit(" "), F.length(m)))


def exclamation_focus(text: Column, words: int = 4) -> Column:
    """Stars around the last word of an exclamation of at most ``words`` words."""
    # possessive: a long word isn't tried as several short ones, nor from each of its letters
    short = text.rlike(rf"^\s*+(?:[\p{{L}}\p{{N}}'’-]++[\s,]*+){{1,{words}}}+!++\s*+$")
    return F.when(short, F.regexp_replace(text, r"(?<![\p{L}\p{N}'’-])([\p{L}\p{N}'’-]++)(?=!++\s*+$)", r"*$1*")).otherwise(text)


def stretched(accented: Column) -> Column:
    """A text of one short stressed word gets its vowel doubled: too short a sound is lost."""
    return F.regexp_replace(accented, rf"(?iu)^(\P{{L}}*[^\P{{L}}{_VOWELS}]?)\+([{_VOWELS}])([^\P{{L}}{_VOWELS}]?[.!?…]*)$", "$1+$2$2$3")


def prefix_hyphens(accented: Column) -> Column:
    """The hyphen after по, во and из is read as a space."""
    return F.regexp_replace(accented, r"(?iu)(?<!\p{L})(по|во|из)-(?=\+?\p{L})", "$1 ")


def before_vowel_numerals(text: Column) -> Column:
    """о before a numeral that begins with a vowel: об."""
    return F.regexp_replace(text, r"(?u)(?<!\p{L})([оО]) (?=(?:од|оди|одинн|восьми?десят)\p{L}*)(?=[аеиоуэ])", "$1б ")


def feminine_accusative(text: Column) -> Column:
    """одна after a preposition of direction or a verb of counting: одну."""
    return F.regexp_replace(text, r"(?iu)(?<!\p{L})(на|за|в|через|про|под) одна (?=\p{L}+(?:у|ю|ь)(?!\p{L}))", "$1 одну ")


def arabic_centuries(text: Column) -> Column:
    """``20 век``: 1 to 30 before a form of the word for century, in Roman numerals, so that the rule
    for Roman numerals inflects them."""
    return regex_map(text, r"(?u)(?<![\d.,-])(\d{1,2})(?:-?(?:й|го|му|м))? (?=век(?:а|у|ом|е)?(?!\p{L}))", 1, lambda m, n, *_: F.when(n.cast("int").between(1, 30), F.concat(N.to_roman(n.cast("int")), F.lit(" "))))


def loudness_match(reference: Column, other: Column) -> Column:
    """The gain that brings ``other`` to the level of ``reference``, between a half and two; 1 for silence."""
    return F.when((reference <= 0) | (other <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(2.0), reference / other)))


def pitch_contour(kind: Column, place: Column, length: Column, strength: float = 0.2) -> Column:
    """A factor on the pitch of the symbol at ``place`` of ``length``: a rise over the last fifth of
    general questions, a decay from the start of exclamations, else 1."""
    at = place / F.greatest(length - 1, F.lit(1))
    rise = F.greatest(F.lit(0.0), (at - 0.8) / 0.2)
    return F.when(kind.isin("general_q", "tag_q"), 1 + strength * rise).when(kind == "exclam", 1 + strength * (1 - at)).otherwise(F.lit(1.0))


def type_per_symbol(sentences: Column, types: Column) -> Column:
    """One type id for each character of each sentence, one after the other."""
    return F.flatten(F.zip_with(sentences, types, lambda s, t: F.array_repeat(t, F.length(s))))


def stress_from_end(form: Column, place: Column) -> Column:
    """A plus before the character that stands ``place`` characters from the end (1 is the last)."""
    at = F.length(form) - place + 1
    return F.when((at >= 1) & (place >= 1), F.concat(form.substr(F.lit(1), at - 1), F.lit("+"), form.substr(at, place))).otherwise(form)


def one_mark_per_part(variant: Column) -> Column:
    """A stress variant if every hyphenated part with two or more vowels has exactly one plus, and
    parts with one vowel at most one; else null."""
    vowels = F.transform(F.split(F.lower(variant), "-"), lambda p: F.struct(F.length(F.regexp_replace(p, f"[^{_VOWELS}]", "")).alias("v"), F.length(F.regexp_replace(p, r"[^+]", "")).alias("m")))
    return F.when(F.forall(vowels, lambda x: F.when(x["v"] >= 2, x["m"] == 1).otherwise(x["m"] <= x["v"])), variant)
