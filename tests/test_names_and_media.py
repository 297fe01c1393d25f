"""Names and shortened nouns, dump cleaning, phrase caches, tempo, on short and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import shortenings as A
from corpusloom.functions import wikitext as X
from corpusloom.operators import names as M
from corpusloom.operators import pcm as P
from corpusloom.operators import stresspass as P2
from corpusloom.streaming import cache as K
from corpusloom.streaming import streams as S


def test_names_narrow_one_another_down(spark):
    endings = spark.createDataFrame(M.RUSSIAN, "ending string, kind string, genders int, cells int")
    texts = ["при Николае II жили", "Ивана Петровича Орлова", "Анна Петровна Орлова", "Елизавете Петровне", "дом Петра I", "Людовик XIV", "Зебра", "", None, "Екатерина II и Пётр III", "Орлова"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.chain): (r.genders, r.cells, r.said) for r in M.chains(rows, endings, "id").select("*", M.said_ordinal(F.col("roman"), F.col("genders"), F.col("cells")).alias("said")).collect()}
    assert got == {
        (0, "Николае II"): (1, 32, "втором"), (1, "Ивана Петровича Орлова"): (1, 10, None), (2, "Анна Петровна Орлова"): (2, 1, None), (3, "Елизавете Петровне"): (2, 36, None),
        (4, "Петра I"): (1, 10, "первого"), (6, "Зебра"): (1, 10, None), (9, "Екатерина II"): (2, 1, "вторая"), (9, "Пётр III"): (1, 1, "третий"), (10, "Орлова"): (3, 11, None),
    }


def test_what_names_share(spark):
    entry = lambda g, c: F.struct(F.lit(g).alias("genders"), F.lit(c).alias("cells"))
    none = F.lit(None).cast("struct<genders: int, cells: int>")
    row = spark.range(1).select(*[M.narrowed(F.array(*x)).alias(str(i)) for i, x in enumerate([[entry(3, 11), entry(1, 10)], [entry(1, 1), entry(2, 2)], [none, entry(2, 4)], [none]])]).first()
    assert [tuple(x) for x in row] == [(1, 10), (1, 1), (2, 4), (3, 63)]


def test_surnames_stand_within_sentences(spark):
    table = spark.createDataFrame([("волков", "в+олков"), ("рогов", "р+огов")], "word string, variant string")
    texts = [(1, "Волков не было. Волков ушёл, Иван Волков тоже"), (2, "— Рогов!"), (3, "без рогов"), (4, None), (5, "пришёл\nВолков, а Рогов?")]
    rows = spark.createDataFrame(texts, "id int, text string")
    assert {(r.id, r.tok_no, r.variant) for r in M.surnames(rows, table, "id").collect()} == {(1, 6, "в+олков"), (5, 3, "р+огов")}


def test_shortened_nouns(spark):
    given = {
        "в гл. 5 и к рис.3": "в главе 5 и к рисунку 3", "с ст. 7": "со статьи 7", "С стр. 2": "Со страницы 2", "см. табл. 1": "см. таблицу 1", "Гл. 2": "Глава 2", "у оз. Нарочь": "у озера Нарочь",
        "под ген. Власовым": "под генералом Власовым", "т. е. так": "т. е. так", "ч. Иванов": "ч. Иванов", "п. № 3": "пункт № 3", "abc1 п.": "abc1 п.", "": "", "из-за р. Дон": "из-за реки Дон", "Согласно ст. 5": "Согласно статье 5",
    }
    rows = spark.createDataFrame([(k,) for k in given] + [(None,)], "t string").select("t", A.noun_shortenings(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == {**given, None: None}


def test_every_shortening_has_six_forms():
    for short in A.NOUNS:
        assert len(set(A.forms(short))) >= 3 and len(A.forms(short)) == 6


def test_nested_brackets():
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice(["{{", "}}", "a", "b", " "]) for _ in range(rng.randint(0, 14)))
        plain = text
        while (cut := plain.rfind("{{", 0, len(plain) if "}}" in plain else 0)) >= 0:
            # the pair of the innermost opening bracket: the last one before the first closing bracket after it
            ends = [i for i in range(len(plain)) if plain.startswith("}}", i)]
            pairs = [(plain.rfind("{{", 0, e), e) for e in ends if plain.rfind("{{", 0, e) >= 0]
            pairs = [(a, e) for a, e in pairs if "}}" not in plain[a + 2 : e]]
            if not pairs:
                break
            a, e = pairs[0]
            plain = plain[:a] + plain[e + 2 :]
        if "{{{" not in text and "}}}" not in text and "{{{" not in plain and "}}}" not in plain and plain.replace("{{", "").replace("}}", "").isascii():
            assert X.without(text, "{{", "}}") == plain or "{{" in plain, text
    assert [d for _, _, d in X.paired("{{a{{b}}c{{d{{e}}}}}}", "{{", "}}")] == [2, 3, 2, 1]
    assert X.without("{{" * 5000 + "x" + "}}" * 5000 + "y", "{{", "}}") == "y"


def test_dumps_are_cleaned(spark):
    text = "'''Дом''' {{шаблон|а={{б|{{в}}}}}} — [[Здание|строение]] и [[сад]].<ref name=\"x\">Т. <i>1</i></ref><ref name=y /> <!-- нет -->[http://x.org слово] [[Файл:a.jpg|мини|Вид [[дом]]а]]{| class=a\n| {{b}} |}конец {{не закрыт"
    assert X.clean(text) == "Дом  — строение и сад. слово конец {{не закрыт"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(X.cleaned(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [X.clean(text), None, ""]
    lines = spark.createDataFrame([("короткая\n* список, в котором больше сорока знаков, но это список\nСтрока текста, в которой больше сорока знаков, остаётся.",)], "t string")
    assert lines.select(X.prose_lines(F.col("t")).alias("p")).first().p == ["Строка текста, в которой больше сорока знаков, остаётся."]
    assert lines.select(X.headings(F.lit("a\n== Глава ==\n=b=")).alias("h")).first().h == "a\nГлава\n=b="


def requests(spark):
    rng = random.Random(8)
    rows = [(o, f"p{rng.randint(0, 9)}", 0, i) for i, o in enumerate(rng.choice(["a", "a", "b"]) for _ in range(400))]
    return [(o, p, 10 + 7 * int(p[1:]), i) for o, p, _, i in rows]


def plain_cache(rows, budget, share):
    held, out = {}, []
    for o, p, size, i in rows:
        own = held.setdefault(o, [])
        hit = any(q == p for q, _ in own)
        gone = 0
        if hit:
            own.append(own.pop(next(k for k, (q, _) in enumerate(own) if q == p)))
        elif size <= budget * share:
            own.append((p, size))
            while sum(s for _, s in own) > budget:
                own.pop(0)
                gone += 1
        out.append((o, p, i, hit, gone))
    return sorted(out, key=lambda r: r[2])


def timed(spark, rows):
    df = spark.createDataFrame(rows, "owner string, phrase string, size long, i long")
    return df.withColumn("ts", F.timestamp_seconds(F.col("i")))


def test_cache_replay_equals_a_plain_cache(spark):
    rows = requests(spark)
    got = K.replay(timed(spark, rows).repartition(3), 200).collect()
    assert sorted(((r.owner, r.phrase, int(r.ts.timestamp()), r.hit, r.evicted) for r in got), key=lambda r: r[2]) == [(o, p, i, h, g) for o, p, i, h, g in plain_cache(rows, 200, 0.25)]
    assert K.replay(timed(spark, rows).where("false"), 200).count() == 0


def test_cache_on_a_stream_equals_the_replay(spark, tmp_path):
    rows = requests(spark)
    for k in range(3):
        timed(spark, rows[k * 140 : (k + 1) * 140]).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # one folder after another: the stream takes one file a batch, oldest first
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "part0")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))
        got = S.run_to_memory(K.cached(stream, 200), "cached_phrases").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(((r.owner, r.phrase, int(r.ts.timestamp()), r.hit, r.evicted) for r in got), key=lambda r: r[2]) == plain_cache(rows, 200, 0.25)


def test_tempo_keeps_pitch_and_length(spark):
    x = np.sin(2 * np.pi * np.arange(4000) / 40)
    for speed in (0.5, 0.8, 1.0, 1.25, 2.0):
        y = P.stretch(x, speed, 160, 40)
        assert len(y) == int(np.floor(len(x) / speed + 0.5))
        middle = y[400:-400]
        crossings = np.flatnonzero((middle[:-1] < 0) & (middle[1:] >= 0))
        assert abs(np.diff(crossings).mean() - 40) < 0.5 and abs(np.abs(middle).max() - 1) < 0.02
    assert len(P.stretch(np.zeros(0), 2.0, 16, 4)) == 0 and P.stretch(x, 1.0, 16, 4).tolist() == x.tolist()
    rows = spark.createDataFrame([([0.1, 0.2, 0.3],), (None,), ([],)], "x array<double>").select(P.stretched(F.col("x"), 1.5).alias("y")).collect()
    assert [r.y and len(r.y) for r in rows] == [2, None, []]
    with pytest.raises(ValueError):
        P.stretched(F.col("x"), 0)


def test_a_users_dictionary(spark):
    words = spark.createDataFrame([("кому-то", "ком+у-то"), ("дом", "д+ом"), ("узнает", "узн+ает"), ("ёлка", "+ёлка"), ("дом", "до+м")], "word string, variant string")
    given = {1: ("Кому-то ДОМ", "Кому-то ДОМ"), 2: ("дом-музей, к+ому-то", "дом-музей, кому-то"), 3: ("узн+ает узнаёт", "узнает узнает"), 4: ("узнаёт елка", "узнаёт елка"), 5: (None, None), 6: ("", ""), 7: ("дом-дом", "дом-дом")}
    rows = spark.createDataFrame([(k, *v) for k, v in given.items()], "id int, text string, before string")
    got = {r.id: r.text for r in P2.user_dictionary(rows, words, "id", source="before").collect()}
    assert got == {1: "Ком+у-то Д+ОМ", 2: "д+ом-музей, к+ому-то", 3: "узн+ает узн+ает", 4: "узнаёт елка", 5: None, 6: "", 7: "д+ом-д+ом"}
    got = {r.id: r.text for r in P2.user_dictionary(rows, words, "id").collect()}
    assert got[3] == "узн+ает узнаёт"


def test_hard_vowels_keep_marks_and_capitals(spark):
    rules = spark.createDataFrame([("тест", "тэст"), ("те*", "те*"), ("бизнес*", "бизнэс*"), ("биз*", "бэз*"), ("проект", "проэкты")], "word string, said string")
    given = {1: ("Т+ест ТЕСТ тесто, б+изнес-план Бизнесмен бизон проект", "Т+эст ТЭСТ тесто, б+изнэс-план Бизнэсмен бэзон проект"), 2: (None, None), 3: ("", ""), 4: ("бизон+ы", "бэзон+ы")}
    rows = spark.createDataFrame([(k, v[0]) for k, v in given.items()], "id int, text string")
    assert {r.id: r.text for r in P2.hard_vowels(rows, rules, "id").collect()} == {k: v[1] for k, v in given.items()}
