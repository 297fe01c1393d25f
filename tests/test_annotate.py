"""Homographs, grammar rules, replacement index, offset maps and marks, word tables, paradigms."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import offsets as O
from corpusloom.operators import frontcoded as C
from corpusloom.operators import grammar as G
from corpusloom.operators import homographs as H
from corpusloom.operators import lexicon as L
from corpusloom.operators import morph as M
from corpusloom.operators import paradigm as D
from corpusloom.operators import wordmarks as W
from corpusloom.operators import yo as Y
from corpusloom.plans import annotate

from .conftest import SF


def test_automaton_finds_every_phrase():
    rng = random.Random(2)
    for _ in range(200):
        phrases = [[rng.choice("abc") for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 8))]
        tokens = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        want = sorted((i, k) for k, p in enumerate(phrases) for i in range(len(tokens)) if tokens[i : i + len(p)] == p)
        assert sorted(H.PhraseAutomaton(phrases).hits(tokens)) == want


PHRASES = [
    ("замок", "старинный замок", "з+амок", 1), ("замок", "навесной замок", "зам+ок", 2), ("замок", "замок двери", "зам+ок", 3), ("замок", "замок замок", "з+амок", 4),
    ("мука", "белая мука", "мук+а", 5), ("мука", "белая мука", "м+ука", 6),
]
TEXTS = [(1, "Старинный замок стоял. Замок двери сломан."), (2, "Старинный ЗАМОК двери"), (3, "Замок, мука и белая Мука"), (4, None), (5, ""), (6, "замок замок")]


def test_phrases_decide_and_the_model_fills_in(spark):
    phrases = spark.createDataFrame(PHRASES, "word string, phrase string, variant string, ord int")
    homodict = spark.createDataFrame([("замок", ["зам+ок", "з+амок"])], "word string, variants array<string>")
    texts = spark.createDataFrame(TEXTS, "id int, text string")
    want = {(1, 1, "замок", "з+амок"), (1, 3, "Замок", "зам+ок"), (2, 1, "ЗАМОК", "з+амок"), (3, 0, "Замок", None), (3, 4, "Мука", "мук+а"), (6, 0, "замок", None), (6, 1, "замок", None)}
    for limit in (1 << 20, 0):
        tags = H.tag(texts, homodict, phrases, "id", limit=limit)
        assert {(r.id, r.tok_no, r.token, r.variant) for r in tags.collect()} == want
    p = spark.createDataFrame([(3, 0, 0.9), (6, 0, 0.5), (1, 1, 0.9)], "id int, tok_no int, p double")
    chosen = H.resolve(tags, p, "id")
    got = {r.id: r.text for r in H.render(texts, chosen, "id").collect()}
    assert got == {1: "Старинный з+амок стоял. Зам+ок двери сломан.", 2: "Старинный З+АМОК двери", 3: "Зам+ок, мука и белая Мук+а", 4: None, 5: "", 6: "з+амок замок"}
    none = phrases.where("false")
    for limit in (1 << 20, 0):
        assert H.tag(texts, homodict.where("false"), none, "id", limit=limit).count() == 0
        assert H.tag(texts.where("false"), homodict, phrases, "id", limit=limit).count() == 0


def test_cells_of_ties_and_cases(spark):
    row = spark.createDataFrame([("зам+ок", "ЗаМок"), ("+ель", "Ель"), ("ёлка", "ЕЛКА"), ("дли+нный", "дли")], "v string, t string")
    assert [r.x for r in row.select(H.cased(F.col("v"), F.col("t")).alias("x")).collect()] == ["ЗаМ+ок", "+Ель", "ЁЛКА", "дли+нный"]


RUSSIAN = [
    ("вдоль стены", ["стен+ы"]), ("через стены", ["ст+ены"]), ("высокие стены", ["ст+ены"]), ("Высокой стены", ["стен+ы"]), ("две толстые стены", ["стен+ы"]), ("я ношу", ["нош+у"]),
    ("в крови", ["кров+и"]), ("бросился в крови", ["кр+ови"]), ("задача учителя", ["уч+ителя"]), ("вдоль, стены", []), ("стены", []), ("из-под стены", ["стен+ы"]), ("размером с стены", ["ст+ены"]),
    ("много стены", ["стен+ы"]), ("его стены", []), ("белого стены", ["стен+ы"]), ("коснулся стены", ["стен+ы"]), ("которой коснулся стены", []), ("", []), (None, []), ("вдоль стены, в крови", ["стен+ы", "кров+и"]),
]


def test_russian_rules(spark):
    gen, nom = M.cell_bit("sg", "gen"), M.cell_bit("sg", "nom")
    pl = M.cell_bit("pl", "nom") | M.cell_bit("pl", "acc")
    tags = [("стены", M.NOUN | M.FEMININE | gen | pl), ("высокие", M.ADJECTIVE | pl), ("высокой", M.ADJECTIVE | M.FEMININE | gen), ("учителя", M.NOUN | M.ANIMATE | gen), ("задача", M.NOUN | M.FEMININE | nom), ("толстые", M.ADJECTIVE | pl)]
    readings = [("стены", {"g": "стен+ы", "p": "ст+ены"}), ("учителя", {"g": "уч+ителя", "n": "учител+я"}), ("крови", {"g": "кр+ови", "l": "кров+и"}), ("ношу", {"v": "нош+у", "n": "н+ошу"})]
    texts = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(RUSSIAN)], "id int, text string")
    tables = spark.createDataFrame(tags, "form string, tags long"), spark.createDataFrame(readings, "word string, readings map<string,string>")
    got = {}
    for r in G.judge(G.tokenise(texts, *tables, "id"), G.parse(G.RUSSIAN), "id").orderBy("id", "tok_no").collect():
        got.setdefault(r.id, []).append(r.reading)
    assert [(p, got.get(i, [])) for i, (p, _) in enumerate(RUSSIAN)] == RUSSIAN


def test_rules_say_what_is_wrong():
    for lines, kind, line in ((["# x", "-1 word a"], "no picks", 2), (["-1 word a ->"], "no picks", 1), (["-1 like a -> g"], "no such test", 1), (["3 word a -> g"], "offset out of reach", 1), (["0 is plural -> g"], "no such tag", 1), (["-1 near x -> g"], "no such test", 1)):
        with pytest.raises(G.RuleError) as e:
            G.parse(lines)
        assert (e.value.kind, e.value.line) == (kind, line)
    assert G.parse(["", "# only a remark"]) == []


def test_first_rule_decides_even_for_silence(spark):
    token = F.struct(F.lit("a").alias("word"), F.lit(0).cast("long").alias("tags"), F.lit(False).alias("near"), F.create_map(F.lit("g"), F.lit("a+")).alias("readings"))
    rows = spark.range(1).select(F.col("id"), F.array(token).alias("tokens"))
    assert G.judge(rows, G.parse(["0 has g -> -", "0 has g -> g"]), "id").count() == 0
    assert G.judge(rows, G.parse(["0 has p -> p", "-1 none, 0 !has p -> p g"]), "id").first().reading == "a+"
    assert G.judge(rows, [], "id").count() == 0


def test_rule_index_equals_all_rules_in_turn():
    rng = random.Random(4)
    stems = ["кот", "дом", "Straße", "İstanbul", "ſoft", "K", "лес", "éclair", "ab", "x"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.choice(stems), rng.choice(stems)
            lines.append(rng.choice([f"{a}* = {b}*", f"*{a} = {b}", f"{a} = {b}", f"${a} = {b}", f"~{a}+ = {b}", f"~({a}|{b}) = <$1>", f"~(?:{a})?{b} = {a}", f"~{a}(?={b}) = -", f"~[{a}]{b} = {b}", f"{a}, {b} = {b}"]))
        rules = L.compile_rules(lines)
        index = L.RuleIndex(rules)
        for _ in range(20):
            text = " ".join(rng.choice(stems + [s.upper() for s in stems] + [s + "ы" for s in stems] + ["кот,", "s", "k", "i"]) for _ in range(rng.randint(0, 8)))
            found, want = {w.lower() for w in re.findall(r"\w+", text)}, text
            for r in rules:
                if r.words <= found:
                    want = r.pattern.sub(r.value, want)
            assert index.apply(text) == re.sub(r" {2,}", " ", want).strip(), (lines, text)


def test_pieces_are_in_every_match():
    for source, want in ((r"abc", ("abc",)), (r"ab?c", ("a", "c")), (r"(?:ab)+c", ("ab", "c")), (r"(a|b)cd", ("cd",)), (r"(?<=x)ab(?!y)$", ("ab",)), (r"a.b", ("a", "b")), (r"(?i:AB)", ("ab",)), (r"x*", ())):
        assert L.required_pieces(source, re.UNICODE | re.IGNORECASE) == want


def test_rules_that_are_wrong_are_reported():
    problems = []
    lines = ["# remark", "", "no separator", "= x", "~(a = b", "~(b) = $2", "~a = $", "~c = x\\", "~(a) = [$1]", "##x = y"]
    rules = L.compile_rules(lines, problems)
    assert [(p.line, p.kind) for p in problems] == [(3, "separator"), (4, "separator"), (5, "pattern"), (6, "group"), (7, "dollar"), (8, "backslash")]
    assert {r.key for r in rules} == {"~(a)", "#x"}


def test_many_rules_are_read_in_time():
    rng = random.Random(0)
    pool = ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randint(4, 9))) for _ in range(20_000)]
    lines = [f"{' '.join(rng.sample(pool, rng.choice([1, 1, 2, 3])))} = {rng.choice(pool)}" for _ in range(61_118)] + [f"{rng.choice(pool)}* = {rng.choice(pool)}*" for _ in range(882)]
    began = time.time()
    index = L.RuleIndex(L.compile_rules(lines))
    assert time.time() - began < 5
    text = " ".join(rng.choice(pool) for _ in range(500))
    index.apply(text)  # compiles the patterns that it needs
    began = time.time()
    index.apply(text)
    assert time.time() - began < 1


def naive_sources(text, pattern, made):
    out, src, done = "", [], 0
    for m in re.finditer(pattern, text):
        out, src, done = out + text[done : m.start()] + made(m), src + list(range(done, m.start())) + [m.start()] * len(made(m)), m.end()
    return out + text[done:], src + list(range(done, len(text) + 1))


def test_maps_compose():
    rng = random.Random(7)
    rules = [(r"a+", lambda m: "xy"), (r"b", lambda m: ""), (r"x", lambda m: "aab"), (r"[yz]b?", lambda m: m[0] * 2)]
    for _ in range(400):
        source = "".join(rng.choice("abxyz") for _ in range(rng.randint(0, 25)))
        text, whole, want = source, O.Map.identity(len(source)), list(range(len(source) + 1))
        for _ in range(rng.randint(1, 5)):
            pattern, made = rng.choice(rules)
            expected, places = naive_sources(text, pattern, made)
            text, step = O.rewrite(text, re.compile(pattern), made)
            whole, want = step.after(whole), [want[p] for p in places]
            assert text == expected and whole.source(np.arange(len(text) + 1)).tolist() == want


def test_tracked_texts_in_spark(spark):
    rows = spark.createDataFrame([(1, "a{x}bc  d"), (2, ""), (3, None), (4, "{x}"), (5, "a,b")], "id int, t string")
    tracked = O.apply(O.track(F.col("t")), [(r"\{x\}", ""), (r" {2,}", " "), (r"c", "<c>")])
    m = F.col("m")
    got = {r.id: r for r in rows.select("id", tracked.alias("m")).select("id", "m", O.sources(m).alias("s"), F.transform(F.sequence(F.lit(-1), F.lit(9)), lambda i: O.source_of(m, i)).alias("at")).collect()}
    assert got[1].m.text == "ab<c> d" and got[1].s == [0, 4, 5, 5, 5, 6, 8] and got[1]["at"] == [0, 0, 4, 5, 5, 5, 6, 8, 9, 9, 9]
    assert (got[2].m.text, got[2].s, got[3].m, got[4].m.text, got[4].s) == ("", [], None, "", [])
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("comma").alias("say")), F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit("no").alias("say")), F.struct(F.lit(7).alias("start"), F.lit(90).alias("end"), F.lit("no").alias("say")))
    said = O.substituted(O.track(F.col("t")), spans)
    row = rows.where("id = 5").select(said.alias("m")).select("m.text", O.sources(m).alias("s")).first()
    assert (row.text, row.s) == ("a comma b", [0, 1, 1, 1, 1, 1, 1, 2, 2])


def test_marks_are_read_and_laid(spark):
    text = "{pause:9}Раз {prosody:80:120}*два три*{pause:300} четыре.{pause:200} {prosody:100:100}Пять"
    plain, m, words = W.parse(text)
    assert plain == "Раз два три, четыре. Пять"
    assert [(w["word"], w["rate"], w["pitch"], w["focus"], w["pause_ms"]) for w in words] == [("Раз", 1, 1, False, 0), ("два", 0.8, 1.2, True, 0), ("три", 0.8, 1.2, True, 300), ("четыре", 0.8, 1.2, False, 200), ("Пять", 1, 1, False, 0)]
    for w in words:
        assert text[w["src"] :].startswith(w["word"]) and plain[w["at"] :].startswith(w["word"]) and m.source(np.array([w["at"]]))[0] == w["src"]
    laid = W.lay(words, "р+аз дв+а тр+и целых, чет+ыре. п+ять")
    assert [(w["word"], w["mark"], w["pause_ms"]) for w in laid] == [("р+аз", 0, 0), ("дв+а", 1, 0), ("тр+и", 2, 0), ("целых", 3, 500), ("чет+ыре", 3, 0), ("п+ять", 4, 0)]
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(W.marked(F.col("t")).alias("m")).select("m.text", W.laid(F.col("m.words"), F.col("m.text")).alias("l")).collect()
    assert [r.text for r in rows] == [plain, None, ""] and len(rows[0].l) == 5 and rows[1].l is None and rows[2].l == []


def test_front_coded_tables_find_what_they_hold(spark):
    rng = random.Random(5)
    keys = sorted({"".join(rng.choice("абвé") for _ in range(rng.randint(0, 7))) for _ in range(900)})
    entries = spark.createDataFrame([(k, bytes([i % 256]) * (i % 3)) for i, k in enumerate(keys) if i % 2] + [(None, b"x"), (keys[1], b"\xff\xff\xff")], "key string, value binary")
    blocks = C.build(entries, block=8).cache()
    want = {k: bytes([i % 256]) * (i % 3) for i, k in enumerate(keys) if i % 2}
    assert {r.key: bytes(r.value) for r in C.expand(blocks).collect()} == want
    words = spark.createDataFrame([(k,) for k in [*keys, "zz", None, keys[1]]], "key string").repartition(5)
    for limit in (1 << 20, 0):
        assert {r.key: bytes(r.value) for r in C.lookup(words, blocks, limit).collect()} == want
    assert C.lookup(words, blocks.where("false")).count() == 0 and C.lookup(words.where("false"), blocks).count() == 0
    plain = sum(len(k.encode()) + len(v) for k, v in want.items())
    assert blocks.agg(F.sum(F.octet_length("data"))).first()[0] < plain + 3 * len(want)


def test_dots_return(spark):
    lines = ["Ёжиков(а|ой)  # names", "ёжик", "_киёв", "# remark", "", "мёд(|а)", "все"]
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    texts = spark.createDataFrame([(1, "Ежик ест мед, ежик! Ежикова ежикова МЕДА киев Киев все"), (2, None), (3, "нет")], "id int, text string")
    for limit in (None, 0):
        got = {r.id: r.text for r in Y.restore(texts, Y.table(Y.entries(rows)), "id", limit=limit).collect()}
        assert got == {1: "Ёжик ест мёд, ёжик! Ёжикова ежикова МЕДА киёв Киев все", 2: None, 3: "нет"}


def test_paradigms_go_both_ways(spark):
    classes = spark.createDataFrame([("m", "", "", "nom"), ("m", "", "а", "gen"), ("m", "", "ов", "gpl"), ("f", "а", "а", "nom"), ("f", "а", "ы", "gen"), ("f", "а", "", "gpl")], "class string, strip string, add string, cell string")
    lemmas = spark.createDataFrame([("ст+ол", "m"), ("стен+а", "f"), ("дом", "m"), ("дом", "m"), (None, "m"), ("лес", None)], "lemma string, class string")
    got = {(r.lemma, r.cell): r.stressed for r in D.expand(lemmas, classes).collect() if r.lemma}
    assert got == {("ст+ол", "nom"): "ст+ол", ("ст+ол", "gen"): "ст+ола", ("ст+ол", "gpl"): "ст+олов", ("стен+а", "nom"): "стен+а", ("стен+а", "gen"): "стен+ы", ("стен+а", "gpl"): "стен", ("дом", "nom"): "дом", ("дом", "gen"): "дома", ("дом", "gpl"): "домов"}
    forms = spark.createDataFrame([("стола",), ("стены",), ("стол",), ("ов",), ("",), (None,), ("домов",)], "form string")
    assert {(r.form, r.lemma, r.cell) for r in D.analyse(forms, lemmas, classes).collect()} == {("стола", "стол", "gen"), ("стены", "стена", "gen"), ("стол", "стол", "nom"), ("домов", "дом", "gpl")}
    counts = spark.createDataFrame([("стол", 30), ("стола", 30), ("столов", 2), ("дом", 9), ("стены", 60)], "word string, n long")
    known = spark.createDataFrame([("стола",)], "word string")
    assert {(r.form, r.n, r.lemma_n) for r in D.candidates(lemmas, classes, counts, [known]).collect()} == {("стол", 30, 62), ("стены", 60, 60)}


ODD = [(1, "Старинный замок\x01замок\x02 двери\x02, МУКА"), (2, " замок"), (3, "замок"), (4, "\x01"), (5, "\x02.\x01,"), (6, None), (7, ""), (None, "белая мука и замок двери. Замок"), (9, "замок двери"), (9, "мука, старинный Замок")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_accented_is_tag_resolve_and_render(spark, limit):
    phrases = spark.createDataFrame([*PHRASES, ("мука", "замок мука", None, 0)], "word string, phrase string, variant string, ord int")
    homodict = spark.createDataFrame([("замок", ["зам+ок", "з+амок"]), ("ЗАМОК", ["зам+ок", "з+амок"]), ("мука", ["мук+а"]), ("двери", None)], "word string, variants array<string>")
    texts = spark.createDataFrame(ODD if limit else ODD[:-2], "id int, text string")
    tags = H.tag(texts, homodict, phrases, "id", limit=limit)
    got = {(r.id, r.tok_no, r.token, r.variant, tuple(r.variants)) for r in tags.collect()}
    two, one = ("з+амок", "зам+ок"), ("мук+а",)
    want = {(1, 1, "замок", "з+амок", two), (1, 2, "замок", "зам+ок", two), (1, 4, "МУКА", None, one), (2, 0, "замок", None, two), (3, 0, "замок", None, two), (None, 1, "мука", "мук+а", one), (None, 3, "замок", "зам+ок", two), (None, 5, "Замок", None, two)}
    same_key = {(9, 0, "замок", "зам+ок", two), (9, 0, "мука", None, one), (9, 2, "Замок", "з+амок", two)}
    assert got == (want | same_key if limit else want) and tags.count() == len(got)
    p = lambda i: F.when(F.coalesce("id", F.lit(0)) != 3, (i % 2 == 1).cast("double"))
    shown = sorted((r.id or 0, r.text) for r in H.accented(texts, homodict, phrases, p, "id", limit=limit).collect() if r.text is not None)
    plain = [(0, "белая мук+а и зам+ок двери. Зам+ок"), (1, "Старинный з+амок\x01зам+ок\x02 двери\x02, МУК+А"), (2, " з+амок"), (3, "замок"), (4, "\x01"), (5, "\x02.\x01,"), (7, "")]
    assert shown == (sorted([*plain, (9, "зам+ок двери"), (9, "мук+а, старинный З+амок")]) if limit else plain)


def test_casing_in_python_is_that_of_the_columns(spark):
    rng = random.Random(6)
    pairs = [("".join(rng.choice("abßİΣσдё+'1ſ") for _ in range(rng.randint(0, 7))), "".join(rng.choice("abABßẞİıΣςдДё'1K") for _ in range(rng.randint(0, 7)))) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "v string, t string").select("v", "t", H.cased(F.col("v"), F.col("t")).alias("x")).collect()
    assert [H._cased(r.v, r.t) for r in rows] == [r.x for r in rows]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_texts_are_accented_where_they_are(spark):
    assert "Exchange" not in plan_of(annotate.homograph_pass(spark, SF))


def test_joined_phrases_give_the_automatons_rows(spark):
    rng = random.Random(11)
    phrases = []
    for i in range(60):
        words = [rng.choice("abcdeé") for _ in range(rng.randint(1, 5))]
        word = rng.choice(words)
        phrases.append((word.upper(), " ".join(words), f"{word}+{i % 7}", rng.randint(0, 40)))
    texts = [(i, " ".join(rng.choice("abcdeéABÉx") for _ in range(rng.randint(0, 12)))) for i in range(120)]
    lists = spark.createDataFrame([("a", ["a+", "+a"]), ("x", ["x+", "+x"])], "word string, variants array<string>"), spark.createDataFrame(phrases, "word string, phrase string, variant string, ord int")
    rows = spark.createDataFrame(texts, "id int, text string")
    one, other = (sorted(map(str, H.tag(rows, *lists, "id", limit=limit).collect())) for limit in (1 << 20, 0))
    assert one == other and sum("variant=None" in r for r in one) > 20 and sum("variants=None" in r for r in one) > 20


def test_joined_phrases_dont_shuffle_open_tokens(spark):
    plan = plan_of(annotate.homograph_counts(spark, SF))
    assert "LeftAnti" not in plan and plan.count("/documents.parquet") == 2
