"""Queries of names, ordinals behind them, surnames and shortened nouns. Their SQL has words of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions import shortenings as A
from ..operators import names as M
from .registry import _WORDS_SQL, _t, query

_KINGS = "Николай Николая Николаю Николаем Николае Елизавета Елизаветы Елизавете Елизавету Елизаветой".split()
_ROMAN = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_STEMS = _list("перв втор трет четвёрт пят шест седьм восьм девят десят одиннадцат двенадцат тринадцат четырнадцат пятнадцат шестнадцат семнадцат восемнадцат девятнадцат двадцат".split())
_HARD = _list("ый ого ому ым ом ая ой ой ую ой".split())
_THIRD = _list("ий ьего ьему ьим ьем ья ьей ьей ью ьей".split())


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey % 10 + 1 AS f, o_orderkey % 20 + 1 AS n FROM orders)
SELECT k, {_list(_KINGS)}[f] || ' ' || {_list(_ROMAN)}[n] AS chain, CASE WHEN f <= 5 THEN 1 ELSE 2 END AS genders,
       {_STEMS}[n] || CASE WHEN n = 3 THEN {_THIRD}[f] WHEN n IN (2, 6, 7, 8) AND f = 1 THEN 'ой' ELSE {_HARD}[f] END AS said FROM o
""")
def ordinals_after_names(spark, sf_dir):
    """Rulers' names with a Roman numeral, one for every order, in all their cases: gender and ordinal."""
    o = _t(spark, sf_dir, "orders")
    form = F.get(F.array(*[F.lit(w) for w in _KINGS]), (F.col("o_custkey") % 10).cast("int"))
    texts = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("и при "), form, F.lit(" "), N.to_roman(F.col("o_orderkey") % 20 + 1), F.lit(" так")).alias("text"))
    endings = spark.createDataFrame(M.RUSSIAN, "ending string, kind string, genders int, cells int")
    found = M.chains(texts, endings, "k")
    return found.select("k", "chain", "genders", M.said_ordinal(F.col("roman"), F.col("genders"), F.col("cells")).alias("said"))


@query(f"""
WITH t AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS tok_no, unnest(ws) AS token, unnest(gs[1:len(ws)]) AS gap FROM (
       SELECT doc_id, {_WORDS_SQL.format('text')} AS ws, string_split_regex(text, '[\\p{{L}}\\p{{N}}]+(?:[''’-][\\p{{L}}\\p{{N}}]+)*') AS gs FROM documents WHERE text IS NOT NULL) WHERE len(ws) > 0),
l AS (SELECT DISTINCT lower(unnest({_WORDS_SQL.format('text')})) AS word FROM benchmark WHERE item_id % 5 = 0)
SELECT doc_id, tok_no, token, regexp_replace(word, '([aeiou])', '+\\1') AS variant FROM t JOIN l ON l.word = lower(token)
WHERE tok_no > 0 AND regexp_matches(token, '^\\p{{Lu}}\\p{{Ll}}') AND NOT regexp_matches(gap, '[.!?…:\\n«"“—–]')
""")
def surname_readings(spark, sf_dir):
    """Words of a list that stand in the documents as surnames: with a capital within a sentence."""
    words = _t(spark, sf_dir, "benchmark").where("item_id % 5 = 0").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"), F.lit(0))).alias("w"))
    table = words.select(F.lower("w").alias("word")).distinct().select("word", F.regexp_replace("word", "^([^aeiou]*)([aeiou])", "$1+$2").alias("variant"))
    return M.surnames(_t(spark, sf_dir, "documents"), table, "doc_id")


_BEFORE = ["", "в ", "из ", "к ", "с ", "под ", "см. ", "через "]
_PARTS = {
    "гл": "глава главы главе главу главой главе", "рис": "рисунок рисунка рисунку рисунок рисунком рисунке", "табл": "таблица таблицы таблице таблицу таблицей таблице",
    "стр": "страница страницы странице страницу страницей странице", "ст": "статья статьи статье статью статьёй статье", "п": "пункт пункта пункту пункт пунктом пункте",
    "ч": "часть части части часть частью части", "кн": "книга книги книге книгу книгой книге", "разд": "раздел раздела разделу раздел разделом разделе", "т": "том тома тому том томом томе",
}
_PLACES = {
    "ул": "улица улицы улице улицу улицей улице", "пл": "площадь площади площади площадь площадью площади", "оз": "озеро озера озеру озеро озером озере", "обл": "область области области область областью области",
    "р": "река реки реке реку рекой реке", "пос": "посёлок посёлка посёлку посёлок посёлком посёлке", "проф": "профессор профессора профессору профессора профессором профессоре",
    "акад": "академик академика академику академика академиком академике", "ген": "генерал генерала генералу генерала генералом генерале", "пр": "проспект проспекта проспекту проспект проспектом проспекте",
}
_CASE = [1, 6, 2, 3, 2, 5, 4, 4]  # of the words before


def _shown(table: dict[str, str], short: str, before: str) -> str:
    forms = "[" + ", ".join(_list(v.split()) for v in table.values()) + "]"
    case = "[" + ", ".join(map(str, _CASE)) + "]"
    word = f"{forms}[{short}][{case}[{before}]]"
    return f"CASE WHEN {before} = 5 AND regexp_matches({word}, '^с[^аеёиоуыэюя]') THEN 'со ' ELSE {_list(_BEFORE)}[{before}] END || {word}"


@query(f"""
SELECT o_orderkey AS k, 'Ответ ' || {_shown(_PARTS, '(o_custkey % 10 + 1)', '(o_orderkey % 8 + 1)')} || ' ' || (o_orderkey % 90 + 1) || ', и т. е. так' AS said FROM orders
UNION ALL
SELECT -1 - c_custkey, 'Он ' || {_shown(_PLACES, '(c_custkey % 10 + 1)', '(c_custkey // 10 % 8 + 1)')} || ' ' || upper(n_name[1]) || lower(n_name[2:]) || ' ул. и п.' FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def said_shortenings(spark, sf_dir):
    """A shortened part with its number for every order and a shortened place or title with a name for every
    customer, after different words: in the case that these ask for."""
    pick = lambda words, i: F.get(F.array(*[F.lit(w) for w in words]), i.cast("int"))
    o = _t(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("Ответ "), pick(_BEFORE, F.col("o_orderkey") % 8), pick(_PARTS, F.col("o_custkey") % 10), F.lit(". "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(", и т. е. так")).alias("t"))
    c = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    name = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring(F.col("n_name"), F.lit(2), F.length("n_name"))))
    b = c.select((-1 - F.col("c_custkey")).alias("k"), F.concat(F.lit("Он "), pick(_BEFORE, F.floor(F.col("c_custkey") / 10) % 8), pick(_PLACES, F.col("c_custkey") % 10), F.lit("."), name, F.lit(" ул. и п.")).alias("t"))
    return a.union(b).select("k", A.noun_shortenings(F.col("t")).alias("said"))
