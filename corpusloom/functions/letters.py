"""Letters, symbols and words: acronyms, spelled characters, emoji and smiley names, camel case,
letters beside digits, keys of words. All are column expressions over small literal tables."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numerals as N
from .regexmap import fold, let, regex_map

VOWELS = "аеёиоуыэюя"

#: Names of the letters of two alphabets.
CYRILLIC_NAMES = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "а бэ вэ гэ дэ е жэ зэ и й ка эль эм эн о пэ эр эс тэ у эф ха цэ че ша ща ъ ы ь э ю я".split(), strict=True))
LATIN_NAMES = dict(zip("abcdefghijklmnopqrstuvwxyz", "эй би си ди и эф джи эйч ай джей кей эль эм эн оу пи кью ар эс ти ю ви дабл-ю экс уай зет".split(), strict=True))
GREEK_NAMES = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "альфа бета гамма дельта эпсилон дзета эта тета йота каппа лямбда мю ню кси омикрон пи ро сигма тау ипсилон фи хи пси омега".split(), strict=True))
SYMBOL_NAMES = {"+": "плюс", "=": "равно", "%": "процент", "&": "и", "@": "собака", "#": "решётка", "*": "звёздочка", "/": "дробь", "©": "копирайт", "°": "градус", "№": "номер", "§": "параграф"}
SMILEYS = {":)": "улыбка", ":-)": "улыбка", ":(": "грусть", ":-(": "грусть", ";)": "подмигивание", ";-)": "подмигивание", ":D": "смех", ":-D": "смех"}
EMOJI_NAMES = {"😀": "улыбка", "😂": "смех до слёз", "👍": "палец вверх", "❤️": "сердце", "❤": "сердце", "🔥": "огонь", "👨‍👩‍👧": "семья", "🎉": "праздник"}


def _table(names: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(names, ensure_ascii=False)), "map<string,string>")


def spelled(word: Column, names: dict[str, str]) -> Column:
    """A word letter by letter; characters without a name are left out."""
    table = _table(names)
    return F.array_join(F.filter(F.transform(F.split(F.lower(word), ""), lambda c: table[c]), lambda x: x.isNotNull()), " ")


def acronyms(text: Column, keep: tuple[str, ...] = ()) -> Column:
    """Runs of two to six Cyrillic or two to five Latin capitals are spelled, unless listed or
    readable (one or two consonants, a vowel, and more consonants). A word is taken with what hyphens join
    to it: with a digit in it, it is a code and stays."""

    def part(p: Column) -> Column:
        n, listed = F.length(p), p.isin(*keep) if keep else F.lit(False)
        readable = F.lower(p).rlike(rf"^[^{VOWELS}]{{1,2}}[{VOWELS}][^{VOWELS}]+(?:[{VOWELS}][^{VOWELS}]*)*$")
        cyrillic = n.between(2, 6) & p.rlike("^[А-ЯЁ]*$") & ~readable & ~listed
        latin = n.between(2, 5) & p.rlike("^[A-Z]*$") & ~listed
        return F.when(cyrillic, spelled(p, CYRILLIC_NAMES)).when(latin, spelled(p, LATIN_NAMES)).otherwise(p)

    def word(m, *_):
        return F.when(~m.rlike(r"\p{N}"), F.array_join(F.transform(F.split(m, "-"), part), "-"))

    return regex_map(text, r"(?:[\p{L}\p{N}]+-)*[\p{L}\p{N}]*\p{Lu}{2}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)*", 0, word)


def lone_letters(text: Column) -> Column:
    """Single Latin and Greek letters by name."""
    text = regex_map(text, r"(?<![\p{L}\d'’])[A-Za-z](?![\p{L}\d'’])", 0, lambda m, *_: _table(LATIN_NAMES)[F.lower(m)])
    return regex_map(text, r"(?<!\p{L})[Α-Ωα-ω](?!\p{L})", 0, lambda m, *_: _table(GREEK_NAMES)[F.lower(m)])


def symbol_names(text: Column) -> Column:
    """Symbols by name, with spaces around them."""
    pattern = "[" + "".join("\\" + s if s in "*/+#&" else s for s in SYMBOL_NAMES) + "]"
    named = regex_map(text, pattern, 0, lambda m, *_: F.concat(F.lit(" "), _table(SYMBOL_NAMES)[m], F.lit(" ")))
    return F.trim(F.regexp_replace(named, " {2,}", " "))


def emoji_names(text: Column) -> Column:
    """The longest sequence at a place counts; repeats are named once; skin tones are dropped."""
    bare = F.regexp_replace(text, "[\\x{1F3FB}-\\x{1F3FF}]", "")
    listed = "|".join(sorted(EMOJI_NAMES, key=len, reverse=True))
    first = "[" + "".join(sorted({name[0] for name in EMOJI_NAMES})) + "]"

    def told(t: Column) -> Column:
        once = F.regexp_replace(t, f"({listed})\\1+", "$1")
        return regex_map(once, listed, 0, lambda m, *_: F.concat(F.lit(", "), _table(EMOJI_NAMES)[m], F.lit(", ")))

    named = let(bare, lambda t: F.when(t.rlike(first), told(t)).otherwise(t))
    return F.trim(fold(named, (r"\s*,(?:\s*,)+", ","), (r"\s+,", ","), (r"^[\s,]+|[\s,]+$", ""), (r",(?=\S)", ", "), (r" {2,}", " ")))


def smiley_names(text: Column) -> Column:
    listed = "|".join(_quoted(s) for s in sorted(SMILEYS, key=len, reverse=True))
    return regex_map(text, rf"(?<![\p{{L}}\d])(?:{listed})(?![\p{{L}}\d])", 0, lambda m, *_: _table(SMILEYS)[m])


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "()[]{}.*+?^$|\\" else c for c in s)


def camel_case(text: Column) -> Column:
    """Parts of a word that a lower-case and a capital letter meet in."""
    return F.regexp_replace(text, r"(?<=\p{Ll}{2})(?=\p{Lu}\p{Ll})", " ")


def letters_beside_digits(text: Column) -> Column:
    """A space between a number and the letters glued to it."""
    return fold(text, (r"(?<=\d)(?=\p{L})", " "), (r"(?<=\p{L})(?=\d)", " "))


def codes(text: Column) -> Column:
    """Cyrillic codes (letters, a hyphen, digits): letters spelled, digits as a number."""

    def say(m, name, digits, tail, *_):
        return F.concat_ws(" ", spelled(name, CYRILLIC_NAMES), F.when(digits.startswith("0"), N.digit_words(digits)).otherwise(N.cardinal(digits.cast("long"))), F.when(tail != "", spelled(tail, CYRILLIC_NAMES)))

    return regex_map(text, r"(?<!\p{L})([А-ЯЁ]{1,4})-(\d{1,6})([А-ЯЁ]?)(?![\p{L}\d])", 3, say)


def word_key(token: Column) -> Column:
    """Letters and digits only, lower case, ё as е."""
    return F.translate(F.lower(F.regexp_replace(token, r"[^\p{L}\p{N}]", "")), "ё", "е")


def pauses_for_parentheses(text: Column) -> Column:
    """Brackets become commas, but not at an edge or beside another mark."""
    opened = F.regexp_replace(text, r"\s*[(\[]\s*", ", ")
    closed = F.regexp_replace(opened, r"\s*[)\]]", ",")
    return F.trim(fold(closed, (r"^[\s,]+", ""), (r",+\s*(?=[,.!?;:…])", ""), (r",\s*$", ""), (r",(?=[^\s])", ", ")))


def render_stress(text: Column, mode: str = "acute") -> Column:
    """Plus signs before stressed vowels as combining acutes after them, or the other way round."""
    if mode == "acute":
        return F.regexp_replace(text, r"\+(\p{L})", "$1́")
    return F.regexp_replace(text, "(\\p{L})́", "+$1")


def final_stop(text: Column) -> Column:
    """The text with one closing mark, and whether a stop was added."""
    t = F.rtrim(text)
    ends = t.rlike(r"[.!?…]$")
    return let(t, lambda x: F.struct(F.when(ends, x).otherwise(F.concat(F.regexp_replace(x, r"[,;:—-]+$", ""), F.lit("."))).alias("text"), (~ends).alias("added")))


#: Fixed values of the language: common masculine nouns in -ь that no ending gives away, and
#: feminine ones with a masculine ending.
MASCULINE_NOUNS = tuple(
    "день пень олень тюлень конь огонь камень корень ремень гребень уровень парень ливень перстень ячмень ясень окунь шампунь июнь июль апрель февраль руль король уголь тополь картофель кабель "
    "отель мотель тоннель портфель щавель профиль стиль автомобиль госпиталь фестиваль вопль контроль пароль алкоголь хмель шмель кисель дождь вождь гвоздь медведь лебедь голубь червь гусь лось карась "
    "зять тесть гость ноготь локоть коготь лапоть дёготь деготь путь зверь якорь егерь лагерь вихрь царь словарь спектакль бинокль рояль хрусталь миндаль".split()
)
FEMININE_NOUNS = tuple("постель артель метель обитель добродетель тварь утварь гарь киноварь псалтырь".split())


def soft_sign_gender(word: Column, masculine: tuple[str, ...] = MASCULINE_NOUNS, feminine: tuple[str, ...] = FEMININE_NOUNS) -> Column:
    """Gender of a noun in -ь: listed nouns first, then masculine endings, else feminine; null for
    other words. Callers with a dictionary of genders join it and keep this for the rest."""
    low = F.lower(word)
    male = ~low.isin(*feminine) & (low.isin(*masculine) | low.rlike("(?:тель|арь|ырь|брь|бль|вль)$"))
    return F.when(low.rlike("ь$"), F.when(male, "m").otherwise("f"))
