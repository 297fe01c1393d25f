"""Alignment against the full table, and word contexts against a window over tokens."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import marks as M
from corpusloom.operators import corpus as C
from corpusloom.operators.align import subsequence


def test_subsequence_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got = subsequence(a, b)
        assert len(got) == t[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_subsequence_of_long_texts():
    words = [str(i % 500) for i in range(5000)]  # beyond any table of all cells
    assert len(subsequence(words, words[:2000] + ["x"] + words[2100:])) == 4900


def test_contexts_by_index_and_by_window(spark):
    docs = spark.createDataFrame([(1, "with a with".split()), (2, ["b"]), (3, []), (4, None), (5, ["With", "x"])], "id long, w array<string>")
    tokens = docs.select("id", F.posexplode("w").alias("tok_no", "token"))
    by_window = C.contexts(tokens, ["id"], "tok_no", "token", F.lower("token") == "with")
    by_index = C.contexts_in_texts(docs, ["id"], F.col("w"), ["with"])
    assert sorted(map(tuple, by_window.collect())) == sorted(map(tuple, by_index.collect()))


def test_marks(spark):
    row = spark.createDataFrame([("привет, мир!", "кот+", None, "сто+л", "20 века")], "a string, b string, c string, d string, e string").select(
        M.exclamation_focus(F.col("a")).alias("focus"), M.one_mark_per_part(F.lit("м+ама-п+апа")).alias("ok"), M.one_mark_per_part(F.lit("мама")).alias("bad"),
        M.is_noise(F.lit("—!?")).alias("noise"), M.is_noise(F.col("c")).alias("none"), M.is_ssml(F.lit(" <Speak>")).alias("ssml"), M.arabic_centuries(F.col("e")).alias("century"),
        M.stress_from_end(F.lit("слово"), F.lit(3)).alias("mark"), M.prefix_hyphens(F.lit("по-м+оему")).alias("prefix"), M.symbol_pauses(F.lit("a → b · c")).alias("pauses"),
        M.image_marks(F.lit("до [image 3] после"), drop=True).alias("image"),
    ).first()
    assert tuple(row) == ("привет, *мир*!", "м+ама-п+апа", None, True, None, True, "XX века", "сл+ово", "по м+оему", "a — b, c", "до после")
