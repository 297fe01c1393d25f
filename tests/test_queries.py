"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import annotate, examples, media, personal, registry, spoken, stress, surveys, wordlists  # noqa: F401

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str(list(v))
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    cols = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_rules_read_whole_tables(spark):
    for name, table in (("documents_punctuation", "documents"), ("pages_entities", "pages")):
        got = registry.QUERIES[name](spark, SF).agg({"*": "count", "output": "count"}).first()
        whole = spark.read.parquet(f"{SF}/{table}.parquet").count()
        assert tuple(got) == (whole, whole)
    assert {"normalise_documents", "normalise_pages", "normalise_phrases"} <= set(registry.QUERIES)


def test_entry_without_the_llm_part():
    """The driver takes the subpackage away; the entry module must do without it."""
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('corpusloom.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'segment_counts_by_lang' in e.queries() and e.oracle_sql()\n"
    )
    from .conftest import ROOT

    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
