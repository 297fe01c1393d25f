"""Queries of structured spans, spelled addresses and segment plans over whole tables. Their SQL has
number words of its own, written out here, so that it checks the words as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import planner as P
from .registry import _t, query


def _words(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


_UNITS = _words("один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать")
_TENS = _words("десять двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто")
_HUNDREDS = _words("сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот")
_NEUTER = _words("первое второе третье четвёртое пятое шестое седьмое восьмое девятое десятое одиннадцатое двенадцатое тринадцатое четырнадцатое пятнадцатое шестнадцатое семнадцатое восемнадцатое девятнадцатое двадцатое")
_OF_YEAR = _words("первого второго третьего четвёртого пятого шестого седьмого восьмого девятого десятого одиннадцатого двенадцатого тринадцатого четырнадцатого пятнадцатого шестнадцатого семнадцатого восемнадцатого девятнадцатого")
_OF_TENS = _words("десятого двадцатого тридцатого сорокового пятидесятого шестидесятого семидесятого восьмидесятого девяностого")
_MONTHS = _words("января февраля марта апреля мая июня июля августа сентября октября ноября декабря")


def _below(n: str, feminine: bool = False) -> str:
    """1 to 999 in words, empty for 0."""
    one = f"CASE WHEN ({n}) % 10 = 1 AND ({n}) % 100 <> 11 THEN 'одна' WHEN ({n}) % 10 = 2 AND ({n}) % 100 <> 12 THEN 'две' ELSE {{}} END" if feminine else "{}"
    last = one.format(f"{_UNITS}[nullif(CASE WHEN ({n}) % 100 < 20 THEN ({n}) % 100 ELSE ({n}) % 10 END, 0)]")
    return f"concat_ws(' ', {_HUNDREDS}[nullif(({n}) // 100, 0)], CASE WHEN ({n}) % 100 >= 20 THEN {_TENS}[({n}) % 100 // 10] END, {last})"


def _agree(n: str, one: str, few: str, many: str) -> str:
    return f"CASE WHEN ({n}) % 100 BETWEEN 11 AND 14 THEN '{many}' WHEN ({n}) % 10 = 1 THEN '{one}' WHEN ({n}) % 10 BETWEEN 2 AND 4 THEN '{few}' ELSE '{many}' END"


def _number(n: str, feminine: bool = False) -> str:
    """Below a million."""
    thousands = f"CASE WHEN ({n}) >= 1000 THEN {_below(f'({n}) // 1000', True)} || ' ' || {_agree(f'({n}) // 1000', 'тысяча', 'тысячи', 'тысяч')} END"
    return f"CASE WHEN ({n}) = 0 THEN 'ноль' ELSE concat_ws(' ', {thousands}, nullif({_below(f'({n}) % 1000', feminine)}, '')) END"


def _group(g: str) -> str:
    """Leading zeros one by one, then the rest as a number."""
    return f"concat_ws(' ', nullif(rtrim(repeat('ноль ', length({g}) - length(ltrim({g}, '0')))), ''), CASE WHEN ltrim({g}, '0') <> '' THEN {_number(f'ltrim({g}, chr(48))::INTEGER')} END)"


def _span(kind: str, **attrs: Column) -> Column:
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
    return S.say(F.lit(kind), F.create_map(*pairs))


@query(f"""
SELECT o_orderkey, CASE WHEN d <= 20 THEN {_NEUTER}[d] WHEN d = 30 THEN 'тридцатое' ELSE CASE WHEN d < 30 THEN 'двадцать ' ELSE 'тридцать ' END || {_NEUTER}[d % 10] END || ' ' || {_MONTHS}[month(o_orderdate)] || ' ' ||
  CASE WHEN y = 2000 THEN 'двухтысячного' ELSE CASE WHEN y < 2000 THEN 'тысяча девятьсот ' ELSE 'две тысячи ' END ||
  CASE WHEN y % 100 < 20 THEN {_OF_YEAR}[y % 100] WHEN y % 10 = 0 THEN {_OF_TENS}[y % 100 // 10] ELSE {_TENS}[y % 100 // 10] || ' ' || {_OF_YEAR}[y % 10] END END || ' года' AS said
FROM (SELECT *, day(o_orderdate) AS d, year(o_orderdate) AS y FROM orders)
""")
def span_dates(spark, sf_dir):
    """The date of every order as a span."""
    d = F.col("o_orderdate")
    return _t(spark, sf_dir, "orders").select("o_orderkey", _span("date", day=F.day(d), month=F.month(d) - 1, year=F.year(d)).alias("said"))


@query(f"""
SELECT event_id, {_number('h')} || ' ' || {_agree('h', 'час', 'часа', 'часов')} || CASE WHEN m = 0 THEN '' ELSE ' ' || {_number('m', True)} || ' ' || {_agree('m', 'минута', 'минуты', 'минут')} END AS said
FROM (SELECT event_id, hour(ts) AS h, minute(ts) AS m FROM events)
""")
def span_times(spark, sf_dir):
    """The clock time of every event as a span."""
    return _t(spark, sf_dir, "events").select("event_id", _span("time", hours=F.hour("ts"), minutes=F.minute("ts")).alias("said"))


@query(f"""
SELECT p_partkey, {_number('c // 100', True)} || ' ' || {_agree('c // 100', 'гривна', 'гривны', 'гривен')} || CASE WHEN c % 100 = 0 THEN '' ELSE ' ' || {_number('c % 100', True)} || ' ' || {_agree('c % 100', 'копейка', 'копейки', 'копеек')} END AS said
FROM (SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS c FROM part)
""")
def span_prices(spark, sf_dir):
    """The price of every part as a span, in a currency whose unit and hundredth are both feminine."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    said = _span("money", currency=F.lit("uah"), integer_part=F.floor(cents / 100), fractional_part=F.lpad((cents % 100).cast("string"), 2, "0"))
    return _t(spark, sf_dir, "part").select("p_partkey", said.alias("said"))


@query(f"""
SELECT l_orderkey, l_linenumber, {_number('n', True)} || ' ' || {_agree('n', 'миля', 'мили', 'миль')} AS said FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS n FROM lineitem)
""")
def span_measures(spark, sf_dir):
    """The quantity of every line as a span with a unit."""
    said = _span("measure", number=F.col("l_quantity").cast("long"), unit=F.lit("Miles"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", said.alias("said"))


@query(f"""
SELECT c_custkey, 'плюс семь, ' || {_group('substr(d, 1, 3)')} || ', ' || {_group('substr(d, 4, 3)')} || ', ' || {_group('substr(d, 7, 2)')} || ', ' || {_group('substr(d, 9, 2)')} AS said
FROM (SELECT c_custkey, lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '0') AS d FROM customer)
""")
def span_phones(spark, sf_dir):
    """A ten-digit number rendered from every customer's key as a span."""
    digits = F.lpad((F.col("c_custkey") * 7919 % 10_000_000_000).cast("string"), 10, "0")
    return _t(spark, sf_dir, "customer").select("c_custkey", _span("telephone", country_code=F.lit("7"), number_parts=digits).alias("said"))


def _address_sql() -> str:
    said = "regexp_replace(lower(url), '^https?://', '')"
    digits = "ноль один два три четыре пять шесть семь восемь девять".split()
    signs = {":": "двоеточие", "/": "слэш", ".": "точка", "?": "вопрос", "&": "амперсанд", "=": "равно", "-": "дефис", "_": "нижнее подчёркивание", "#": "решётка", "%": "процент", "+": "плюс", "@": "собака", "~": "тильда"}
    for sign, word in (dict(zip("0123456789", digits, strict=True)) | signs).items():
        said = f"replace({said}, '{sign}', ' {word} ')"
    letters = "эй би си ди и эф джи эйч ай джей кей эль эм эн оу пи кью ар эс ти ю ви дабл-ю экс уай зет".split()
    named = f"CASE WHEN regexp_full_match(w, '[a-z]') THEN {_words(' '.join(letters))}[ascii(w) - 96] ELSE w END"
    return f"SELECT page_id, array_to_string(list_transform(list_filter(string_split({said}, ' '), lambda w: w <> ''), lambda w: {named}), ' ') AS said FROM pages"


@query(_address_sql())
def spelled_addresses(spark, sf_dir):
    """The address of every page, spelled."""
    return _t(spark, sf_dir, "pages").select("page_id", S.spelled_address(F.col("url")).alias("said"))


@query(r"""
WITH h AS (SELECT doc_id, text, substr(text, 1, 100) AS head FROM documents),
     c AS (SELECT *, length(regexp_extract(head, '(?s)^(.*,)(?:[^0-9]|$)', 1)) AS comma, length(regexp_extract(head, '(?s)^(.*[\t\n\f\r\x0B ])', 1)) AS space FROM h)
SELECT doc_id, CASE WHEN length(text) <= 100 THEN length(text) WHEN comma > 0 THEN comma WHEN space > 0 THEN space ELSE length(text) END::BIGINT AS cut FROM c
""")
def first_cuts(spark, sf_dir):
    """Where the first piece of every document ends, so that speaking begins soon."""
    return _t(spark, sf_dir, "documents").select("doc_id", P.cut_measured(F.col("text"), 100).cast("long").alias("cut"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
     m AS (SELECT doc_id, len(l) AS n, list_filter(list_transform(l, lambda x, i: {'noise': NOT regexp_matches(x, '[\p{L}\p{N}]'),
       'mark': regexp_matches(x, '[.,:;!?…—–-][^\p{L}\p{N}]*$') OR regexp_matches(coalesce(l[i + 1], ''), '^[^\p{L}\p{N}]*[.,:;!?…—–-]')}), lambda p: NOT p.noise) AS kept FROM l)
SELECT doc_id, CASE WHEN n = 1 THEN 1 ELSE len(kept) END::BIGINT AS pieces, CASE WHEN n = 1 THEN 0 ELSE coalesce(list_sum(list_transform(kept[1:len(kept) - 1], lambda p: CASE WHEN p.mark THEN 400 ELSE 80 END)), 0) END::BIGINT AS pause_ms FROM m
""")
def seam_pauses(spark, sf_dir):
    """Pauses between the lines of every document, by the marks at their seams, in total."""
    pieces = P.joined_pauses(F.split("text", "\n", -1), 400, 80)
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", pieces.alias("p"))
    return docs.select("doc_id", F.size("p").cast("long").alias("pieces"), F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["pause_ms"]).alias("pause_ms"))


@query(None)
def segment_plans(spark, sf_dir):
    """The segments of every document, with the pause after each."""
    return P.segments(_t(spark, sf_dir, "documents").select("doc_id", "text"), limit=200)
