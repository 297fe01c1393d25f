"""Every stage of the pipeline keeps the caller's columns, whatever they are called, and takes odd rows; the
queries' columns equal what the libraries give."""

import hashlib
import zlib

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import langid, quality, queries, ruleclf, urlfilter

from ..conftest import SF

NAMES = ["language", "quality_verdict", "quality_score", "quality_good", "stats", "label", "key", "n", "class_id", "markers", "t", "row", "best", "id", "of", "k", "d", "Language_"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None, None, None, None, None), (None, "an odd text without an id", "en", None, None), (900_001, "", None, "s", 0), (900_002, None, "en", "s", None), (900_003, "word " * 30_000, "en", "s", 1)], docs.schema)
    rows = docs.union(more).union(docs.limit(2))
    return rows.withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES})


def test_stages_return_the_callers_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    given = {tuple(r) for r in odd.collect()}
    for name in ("language", "quality", "near_duplicates", "decontamination"):
        out = stages[name](spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert rows and set(rows) <= given, name
        assert stages[name](spark, odd.where("false"), SF).count() == 0, name
    tokens = stages["tokens"](spark, odd, SF)
    assert tokens.count() == odd.count() and tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert stages["tokens"](spark, odd.where("false"), SF).count() == 0


def test_results_stand_beside_clashing_columns(spark, odd):
    small = odd.where("doc_id < 20 or doc_id is null or doc_id > 900000")
    for made, name in ((langid.identify(small, small), "language"), (quality.judge_documents(small), "quality_verdict"), (ruleclf.score_documents(small, spark.read.parquet(f"{SF}/labels.parquet")), "quality_good")):
        assert made.where(F.col(name) != F.concat(F.lit(f"own {name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))).count() == 0
        assert f"{name}_" in made.columns or f"{name}__" in made.columns
    pages = spark.createDataFrame([(1, "http://a.com/", "mine")], "page_id int, url string, URL_VERDICT string")
    row = urlfilter.judge_urls(pages, [urlfilter.Rule("com", "/", "block")]).first()
    assert row.URL_VERDICT == "mine" and row.url_verdict_.verdict == "block"


def test_a_missing_id_is_in_neither_part(spark, odd, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (queries.op5_language, queries.op10_quality_classifier):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == odd.count() and {r.held_out for r in rows if r.doc_id is None} == {False}
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)


def little_endian(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_token_queries_equal_the_libraries(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    words = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    start, want = 0, []
    for doc_id, text in docs:
        ids = [*words.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(little_endian(ids))))
        start += len(ids)
    got = queries.op6_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    own = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    own.no_truncation()
    own.no_padding()
    want = []
    for doc_id, text in docs:
        ids = own.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(little_endian(ids)).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = queries.op7_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want
    pieces = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = [(d, len(t.encode()), n := len(pieces.encode(t)), n > 4096) for d, t in docs]
    got = queries.op9_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, got)) == want
