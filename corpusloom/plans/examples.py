"""Documented examples of every text rule as queries: short inputs, and the expected outputs as a
literal table in SQL. The rules that take free text are queries over whole tables as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters as X
from ..functions import notation as T
from ..functions import numerals as N
from ..functions import rules as R
from ..functions import slavic as V
from ..operators import align as A
from ..operators import lexicon as L
from ..operators import morph as M
from ..operators import segment as S
from ..sources import readers
from .registry import ORACLE_SQL, QUERIES, _t

#: Rule name: (column function, inputs and expected outputs).
EXAMPLES: dict[str, tuple[Callable[[Column], Column], list[tuple[str, str | None]]]] = {
    "cardinal_nominative": (lambda c: N.cardinal(c.cast("long")), [("0", "ноль"), ("42", "сорок два"), ("1000", "одна тысяча"), ("2500", "две тысячи пятьсот"), ("1000001", "один миллион один"), ("-19", "минус девятнадцать")]),
    "cardinal_genitive": (lambda c: N.cardinal(c.cast("long"), "gen"), [("500", "пятисот"), ("90", "девяноста"), ("2021", "двух тысяч двадцати одного")]),
    "cardinal_instrumental": (lambda c: N.cardinal(c.cast("long"), "ins"), [("500", "пятьюстами"), ("8", "восемью"), ("40", "сорока")]),
    "cardinal_feminine": (lambda c: N.cardinal(c.cast("long"), "nom", "f"), [("1", "одна"), ("12", "двенадцать"), ("22", "двадцать две")]),
    "ordinal_nominative": (lambda c: N.ordinal(c.cast("long")), [("3", "третий"), ("40", "сороковой"), ("2020", "две тысячи двадцатый"), ("90000", "девяностотысячный")]),
    "plural_noun": (lambda c: N.plural(c.cast("long"), "час", "часа", "часов"), [("1", "час"), ("3", "часа"), ("11", "часов"), ("21", "час"), ("114", "часов")]),
    "roman_to_number": (lambda c: N.from_roman(c).cast("string"), [("XIV", "14"), ("MCMXCIX", "1999"), ("IIII", None)]),
    "number_to_roman": (lambda c: N.to_roman(c.cast("int")), [("14", "XIV"), ("3999", "MMMCMXCIX"), ("4000", None)]),
    "digit_groups": (N.grouped_digits, [("1234", "12, 34"), ("1234567", "123, 45, 67"), ("123456", "123, 456")]),
    "date": (R.dates, [("05.12.2020", "пятого декабря две тысячи двадцатого года"), ("2001-02-03", "третьего февраля две тысячи первого года"), ("45.12.2020", "45.12.2020")]),
    "time": (R.times, [("в 21:30", "в двадцать один час тридцать минут"), ("25:10", "25:10")]),
    "case_by_preposition": (R.cases, [("около 500 рублей", "около пятисот рублей"), ("к 7", "к семи"), ("между 2 и 5", "между двумя и 5")]),
    "money": (R.money, [("5 руб. 30 коп.", "пять рублей тридцать копеек"), ("$21", "двадцать один доллар")]),
    "units": (R.units, [("5 км", "пять километров"), ("21 мин", "двадцать одна минута"), ("2 т", "две тонны")]),
    "century": (R.roman, [("в XX веке", "в двадцатом веке"), ("XVIII век", "восемнадцатый век")]),
    "thousands": (R.thousands, [("1 200 читателей", "1 200 читателей"), ("12 345 678", "12345678"), ("1.234.567", "1234567"), ("1.5", "1.5")]),
    "decimal": (R.decimals, [("3.5", "три целых пять десятых"), ("21,01", "двадцать одна целая одна сотая")]),
    "percent": (R.percents, [("22%", "двадцать два процента"), ("3,5%", "три целых пять десятых процента")]),
    "fraction": (R.fractions, [("1/2", "одна вторая"), ("2/3", "две третьих"), ("3/4", "три четвёртых")]),
    "phone": (R.phones, [("+7 012 345-06-78", "плюс семь, ноль двенадцать, триста сорок пять, ноль шесть, семьдесят восемь")]),
    "long_number": (R.whole_numbers, [("1234567890123", "один два три четыре пять шесть семь восемь девять ноль один два три"), ("17", "семнадцать")]),
    "footnote": (R.footnotes, [("слово[12].", "слово."), ("слово²", "слово")]),
    "punctuation": (R.punctuation, [("да!!! нет...", "да! нет…"), ("раз,два", "раз, два"), ("a -> b", "a — b")]),
    "homoglyph": (R.homoglyphs, [("cлoвo", "слово"), ("wоrd", "word")]),
    "transliteration": (R.transliterate, [("shop", "шоп"), ("music", "мусик"), ("text", "текст")]),
    "entities": (R.decode_entities, [("a &lt; b &#233; &#x42F; &nope;", "a < b é Я &nope;")]),
    "url_host": (R.url_host, [("https://www.example.com/a?b", "example.com"), ("example.org:80/x", "example.org")]),
    "link_to_host": (R.links, [("см. https://www.example.com/a?b тут", "см. example.com тут"), ("без ссылок", "без ссылок")]),
    "acronym": (X.acronyms, [("США, USB, НАТО", "эс ша а, ю эс би, НАТО")]),
    "lone_letter": (X.lone_letters, [("ось x и α", "ось экс и альфа")]),
    "symbol": (X.symbol_names, [("a+b", "a плюс b")]),
    "emoji": (X.emoji_names, [("да 👍👍", "да, палец вверх")]),
    "smiley": (X.smiley_names, [("да :) и :-(", "да улыбка и грусть")]),
    "camel_case": (X.camel_case, [("OpenOffice", "Open Office")]),
    "cyrillic_code": (X.codes, [("Р-9", "эр девять"), ("ТУ-007А", "тэ у ноль ноль семь а")]),
    "word_key": (X.word_key, [("«Ёлка!»", "елка")]),
    "parentheses": (X.pauses_for_parentheses, [("Он (сам) пришёл (да).", "Он, сам, пришёл, да.")]),
    "stress_mark": (X.render_stress, [("з+амок", "за́мок")]),
    "soft_sign_gender": (X.soft_sign_gender, [("учитель", "m"), ("ночь", "f"), ("дом", None)]),
    "dehyphenation": (S.dehyphenate, [("сло-\nво", "слово"), ("Нью-\nЙорк", "Нью-\nЙорк")]),
    "soft_break": (S.join_soft_breaks, [("раз\nдва", "раз два"), ("раз\nДва", "раз\nДва")]),
    "sentence_type": (lambda c: S.sentence_type(c, ("кто", "что"), ("не так ли",), "или"), [("Кто там?", "wh_q"), ("Да или нет?", "alternative_q"), ("Придёшь?", "general_q"), ("Ура!", "exclam"), ("Да.", "st"), ("Это он, не так ли?", "tag_q")]),
    "ssml": (lambda c: F.to_json(A.ssml(c)), [('<speak>раз <break time="1s"/>два &amp; три</speak>', '[{"text":"раз","pause_ms":0,"rate":1.0},{"text":"два & три","pause_ms":1000,"rate":1.0}]')]),
    "sentences": (lambda c: F.array_join(S.sentence_array(c, ("ул",)), "|"), [("Дом на ул. Мира. А. Петров пришёл! Да?", "Дом на ул. Мира.|А. Петров пришёл!|Да?")]),
    "bounded_pieces": (lambda c: F.array_join(S.bounded_pieces(c, 12), "|"), [("один два, три четыре пять", "один два,|три четыре|пять"), ("коротко", "коротко")]),
    "speech_pieces": (lambda c: F.to_json(S.speech_pieces(c)), [("— Да, — сказал он.", '[{"text":"Да,","speech":true},{"text":"сказал он.","speech":false}]')]),
    "basic_tokens": (lambda c: F.array_join(A.basic_tokens(c), "|"), [("Unaffable, x!", "unaffable|,|x|!")]),
    "wordpiece": (lambda c: F.array_join(A.wordpieces(A.basic_tokens(c), ["un", "##aff", "##able", ","]), " "), [("Unaffable, x", "un ##aff ##able , [UNK]")]),
    "symbol_ids": (lambda c: F.array_join(A.symbol_ids(c, {"a": 5, "b": 6}, 1, 2), ","), [("a?b", "1,5,6,2"), ("", "1,2")]),
    "replacement_list": (lambda c: L.replace(c, ["кот* = пёс*", "~(a)(b) = $2$1", "New York = Нью-Йорк", "$US = эс-ша"]), [("ab котик в new york, us US", "ba пёсик в Нью-Йорк, us эс-ша")]),
    "stress_line": (lambda c: F.to_json(readers.stress_lines(c)), [("Замок з+амок # x", '{"word":"замок","variant":"з+амок"}'), ("# note", None), ("", None)]),
    "import_lines": (lambda c: F.array_join(readers.imported_lines(c), "|"), [("а=+а\r\nб б", "а +а|б б")]),
    "replacement_writer": (lambda c: readers.replacement_line(c, F.lit("x#")), [("ключ", "ключ=x##"), ("~а", "~а = x##")]),
    "vowel_places": (lambda c: F.array_join(L.vowel_places(c, X.VOWELS), ","), [("молоко", "2,4,6"), ("", "")]),
    "governed_numeral": (
        lambda c: M.governed_numeral(F.split(c, ":")[0].cast("long"), F.split(c, ":")[1].cast("int")),
        [(f"3:{M.NOUN | M.cell_bit('sg', 'gen')}", "три"), (f"5:{M.NOUN | M.cell_bit('pl', 'ins')}", "пятью"), (f"2:{M.NOUN | M.FEMININE | M.cell_bit('sg', 'gen')}", "две"), (f"5:{M.NOUN | M.cell_bit('pl', 'dat') | M.cell_bit('pl', 'ins')}", None)],
    ),
    "sole_case": (lambda c: M.sole_case(M.agreeing_cells(F.split(c, ":")[0].cast("int"), F.split(c, ":")[1].cast("int"))), [("3:2", "gen"), ("3:3", None), ("2:64", None)]),
    "cardinal_ukrainian": (lambda c: V.cardinal(c.cast("long"), "uk"), [("2021", "дві тисячі двадцять один"), ("115", "сто п’ятнадцять")]),
    "cardinal_ukrainian_genitive": (lambda c: V.cardinal(c.cast("long"), "uk", "gen"), [("500", "п’ятисот"), ("1000", "однієї тисячі")]),
    "cardinal_belarusian": (lambda c: V.cardinal(c.cast("long"), "be"), [("2019", "дзве тысячы дзевятнаццаць"), ("60", "шэсцьдзясят")]),
    "short_u_belarusian": (V.short_u, [("яна у доме", "яна ў доме"), ("ён у доме", "ён у доме")]),
    "date_ukrainian": (lambda c: V.day_month(c, "uk"), [("24.08.1991", "двадцять четвертого серпня 1991")]),
    "ordinal_suffix": (T.ordinal_suffixes, [("5-й и 3-я, 20-го, 2-е", "пятый и третья, двадцатого, второе")]),
    "case_suffix": (T.case_suffixes, [("5-ти, 3-х, 7-мя", "пяти, трёх, семью")]),
    "year": (T.years, [("в 1999 году", "в тысяча девятьсот девяносто девятом году"), ("2020 год", "две тысячи двадцатый год"), ("в 1812 г.", "в тысяча восемьсот двенадцатом году"), ("с 2001 года", "с две тысячи первого года")]),
    "day_range": (T.day_ranges, [("3-15 мая", "с третьего по пятнадцатое мая"), ("15-3 мая", "15-3 мая")]),
    "day_month": (T.day_month, [("9 мая", "девятого мая"), ("45 мая", "45 мая")]),
    "page_range": (T.page_ranges, [("стр. 12–15", "страницы с двенадцатой по пятнадцатую")]),
    "unit_range": (T.unit_ranges, [("от 5 до 7 км", "от пяти до семи километров")]),
    "half_scale": (T.half_scales, [("2,5 млн", "два с половиной миллиона"), ("1,5 тыс.", "полторы тысячи"), ("21,5 млн", "21,5 млн"), ("5,5 млрд", "пять с половиной миллиардов")]),
    "scale": (T.scales, [("5 тыс.", "пять тысяч"), ("2 млн", "два миллиона"), ("3,2 млрд", "три целых две десятых миллиарда")]),
    "degree": (T.degrees, [("-5 °C", "минус пять градусов Цельсия"), ("21°", "двадцать один градус")]),
    "number_sign": (T.number_signs, [("№ 5 и § 7", "номер пять и параграф семь")]),
    "section": (T.section_numbers, [("п. 2.3.1", "п. два точка три точка один"), ("1.5", "1.5")]),
    "dimension": (T.dimensions, [("5х10", "пять на десять")]),
    "power": (T.powers, [("5² и 2³", "пять в квадрате и два в кубе")]),
    "arithmetic": (T.arithmetic, [("2 + 3 = 5", "2 плюс 3 равно 5"), ("10-20", "10-20"), ("≥ 5", " больше или равно 5")]),
    "number_prefix": (T.signs_before_numbers, [("-5 и ~7, 10-20", "минус 5 и примерно 7, 10-20")]),
    "abbreviation": (T.abbreviations, [("г. Москва и т. д.", "город Москва и так далее"), ("т. е. до н. э.", "то есть до нашей эры")]),
    "spoon": (T.spoons, [("2 ст. л. и 1 ч. л.", "две столовые ложки и одна чайная ложка")]),
    "requisite": (T.requisites, [("код 1204", "код двенадцать, ноль четыре")]),
}


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _register(name: str, rule: Callable[[Column], Column], rows: list[tuple[str, str | None]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, input string")
        return df.select("id", "input", rule(F.col("input")).alias("output"))

    QUERIES[f"rule_{name}"] = run
    ORACLE_SQL[f"rule_{name}"] = "SELECT id, input, output FROM (VALUES " + ", ".join(f"({i}, {_literal(a)}, {_literal(b)})" for i, (a, b) in enumerate(rows)) + ") t(id, input, output)"


for _name, (_rule, _rows) in EXAMPLES.items():
    _register(_name, _rule, _rows)


#: Examples whose input is no free text: numbers, single words or lines of a list.
NOT_TEXT = {
    "cardinal_nominative", "cardinal_genitive", "cardinal_instrumental", "cardinal_feminine", "ordinal_nominative", "plural_noun", "roman_to_number", "number_to_roman", "digit_groups",
    "governed_numeral", "sole_case", "cardinal_ukrainian", "cardinal_ukrainian_genitive", "cardinal_belarusian",
}


def _register_whole(name: str, rule: Callable[[Column], Column]) -> None:
    def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _t(spark, sf_dir, "documents").select("doc_id", rule(F.col("text")).alias("output"))

    def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _t(spark, sf_dir, "pages").select("page_id", rule(F.col("html")).alias("output"))

    QUERIES[f"documents_{name}"] = documents
    QUERIES[f"pages_{name}"] = pages


for _name, (_rule, _) in EXAMPLES.items():
    if _name not in NOT_TEXT:
        _register_whole(_name, _rule)
