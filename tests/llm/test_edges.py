"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing
columns, for every operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from corpusloom.llm import bpe, decontam, langid, neardup, quality, ruleclf, sharding, tokencount, tokenout, urlfilter

from ..conftest import SF

LONG = "the quick brown fox " * 9000
ROWS = [(1, None, "en", "x"), (2, "", None, "x"), (3, LONG, "en", None), (4, "one two", "de", "x"), (4, "one two", "de", "x"), (None, "no id here at all", "en", "x"), (5, "one two", "de", "y")]
SCHEMA = "doc_id long, text string, lang string, _stats string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"key": F.lit(1), "bands": F.lit(2), "bucket": F.lit("b"), "_found": F.lit(0), "size": F.lit(3)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(odd, none):
    out = sharding.shard_documents(odd, shards=3, bucket_groups=2, fan_in=2).collect()
    assert len(out) == len(ROWS) and {r.size for r in out if r.doc_id in (1, 2)} == {16}
    assert len({r.shard for r in out if r.doc_id in (4, 5)}) == 1
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(none).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "nothing"), (3, "http://WWW.Example.COM/en/x?q"), (4, "http://example.com"), (5, "x://a.net/fr/?"), (6, "https://b.net/fr"), (7, "http://netx/fr/"), (7, "http://netx/fr/")]
    rules = [urlfilter.Rule("com", "/", "allow"), urlfilter.Rule("example.com", "/en/", "block"), urlfilter.Rule("www.example.com", "/en/", "allow"), urlfilter.Rule("net", "/fr/", "block"), urlfilter.Rule("net", "/f", "allow")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(df, rules).select("page_id", "url_verdict.*").collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: ("www.example.com/en/", "allow"), 4: (None, "allow"), 5: ("net/fr/", "block"), 6: ("net/f", "allow"), 7: (None, "allow")}
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge_urls(df, rules, max_rules=2)


def test_decontamination(spark, odd, none):
    item = "the benchmark asks which river runs past the old mill. it is the green river"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(9, f"some words before it {item} and others behind"), (10, "clean text with a mill and a river")], "doc_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()] == [(9, 1)]
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {1, 2, 3, 4, 5, 10, None}
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_quality(odd, none):
    got = {r.doc_id: r.v for r in quality.judge_documents(odd).select("doc_id", F.col("quality_verdict").alias("v")).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[3].n_words == 36000 and got[3].n_repeat_words == 36000 and got[3].base_failed
    assert quality.judge_documents(none).count() == 0


def test_language(odd, none, spark):
    learn_from = spark.createDataFrame([(i, f"der hund und die katze {i} laufen schnell" if i % 2 else f"the dog and the cat {i} run fast", "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")
    rows = langid.identify(odd.unionByName(spark.createDataFrame([(6, "123 !!", None, "")], SCHEMA), allowMissingColumns=True), learn_from).select("doc_id", "language").collect()
    got = {r.doc_id: r.language for r in rows}
    assert len(rows) == len(ROWS) + 1
    assert all(got[i].lang == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 6))
    assert got[3].lang == "en" and 0 < got[3].score <= 1
    assert langid.identify(none, learn_from).count() == 0
    assert {r.language.lang for r in langid.identify(odd, none).collect()} == {"und"}


def test_languages_of_one_document_and_unlearned_ones(spark):
    learn_from = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one = spark.createDataFrame([(10**6, "zyx qwv zyxq wvzy xqwv zyyx qqwv " * 20, "xx")], learn_from.schema)
    model = langid.learn(learn_from.union(one))
    assert "xx" in model.langs
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. "
    junk = "xkqj zzvw qpfh wmmb jjtq vxzc kkrw ppqz gtfd hnbv "
    rows = [(1, "zyxq wvzy xqwv zyx " * 20), (2, polish * 8), (3, junk * 12), (4, learn_from.first().text)]
    got = {r.doc_id: r.language for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), learn_from, model=model).collect()}
    assert got[1].lang == "xx" and got[2].rejected and got[3].rejected and not got[4].rejected
    clean = langid.identify(learn_from, learn_from, model=model)
    assert clean.where("language.rejected").count() <= 0.005 * learn_from.count()


def test_token_files(odd, none, spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenout.write_tokens(odd, path, str(tmp_path / "t"))
    out = sorted(tokenout.positions(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 4, 4, 5] and out[1].n_tokens == out[2].n_tokens == 1
    assert [r.start for r in out[1:]] == [a.start + a.n_tokens for a in out[:-1]]
    assert tokenout.look_up(spark, str(tmp_path / "t"), [4]).count() == 2
    placed = {r.row: (r.doc_id, r.ids) for r in tokenout.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert [placed[r][0] for r in sorted(placed)] == [None, 1, 2, 3, 4, 4, 5]
    tokenout.write_tokens(none, path, str(tmp_path / "n"))
    assert tokenout.positions(spark, str(tmp_path / "n")).count() == 0


def test_starts_follow_the_files_for_one_id(spark, tmp_path):
    docs = spark.createDataFrame([(i % 3, f"text number {i} of some " + "words " * (i % 7)) for i in range(300)], "doc_id long, text string")
    tokenout.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "t"), files=5)
    at = 0
    crc = {r.start: (r.n_tokens, r.ids_crc32) for r in tokenout.positions(spark, str(tmp_path / "t")).collect()}
    for r in tokenout.read_tokens(spark, str(tmp_path / "t")).orderBy("row").collect():
        assert crc.pop(at) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += len(r.ids)
    assert not crc


def test_look_ups_skip_row_groups(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of "), "id").alias("text"))
    tokenout.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "t"), files=2)
    for ids, found in (([12_345], 1), ([3, 19_999], 2), ([50_000], 0)):
        out = tokenout.look_up(spark, str(tmp_path / "t"), ids)
        plan = out._jdf.queryExecution().executedPlan()
        assert out._jdf.queryExecution().toRdd().count() >= 0 and out.count() == found
        read = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
        assert read <= 1000 * found  # a row group of 1,000 rows for each id


def test_bpe_and_counts(odd, none):
    t = bpe.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = odd.select("text", t.alias("t"), tokencount.token_count(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("n")).collect()
    assert all(r.t.decoded == (r.text or "") and len(r.t.ids) == 4 * r.t.n_tokens for r in rows)
    assert {r.n for r in rows if not r.text} == {0}
    assert none.select(t).count() == 0


def test_special_tokens_in_bulk():
    own = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    text = "a <|endoftext|>b" * 2000 + "<|endoftext|"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_near_duplicates(odd, none):
    got = [(r.doc_id, r.class_id) for r in neardup.near_duplicates(odd).collect()]
    assert len(got) == len(ROWS) and sorted(c for d, c in got if d in (4, 5)) == [4, 4, 4]
    assert dict(got)[1] == 1 and dict(got)[2] == 2
    assert sorted(str(r.doc_id) for r in neardup.deduplicate(odd).collect()) == ["1", "2", "3", "4", "None"]
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicate(none).count() == 0
    assert neardup.deduplicate(odd).columns == odd.columns


def test_near_duplicates_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, near = " ".join(words), " ".join(reversed(words)), " ".join([*words[:59], "end"])
    rows = [(1, a), (7, a), (7, b), (7, b), (8, near), (None, near), (None, None), (None, None), (9, None)]
    kept = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("1", a), ("7", b), ("None", "None"), ("None", "None"), ("9", "None")])
    # near copies of a text that has no id are linked too
    rows = [(None, a), (None, near), (3, b)]
    out = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 2 and {r.doc_id for r in out} == {None, 3}


def test_classifier(odd, none, spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (77, 1, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = ruleclf.score_documents(odd, labels)
    assert out.count() == len(ROWS) and out.where("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0
    assert ruleclf.score_documents(none, labels).count() == 0
    assert {r.quality_score for r in ruleclf.score_documents(odd, labels.limit(0)).collect()} == {0.5}
