"""Every query of the catalogue against DuckDB on the driver's smallest tables."""

import decimal

import duckdb
import pytest

from millrace.plans.catalogue import ORACLES, QUERIES

TABLES = "events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    rows = duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert got == sorted(([plain(x) for x in r] for r in rows), key=repr)


def test_hashing_embeddings_are_unit_vectors(spark, sf_dir):
    for r in QUERIES["hashing_embeddings"](spark, sf_dir).collect():
        assert len(r.vector) == 32 and abs(sum(x * x for x in r.vector) - 1) < 1e-5


def test_hashing_embeddings_read_whole_texts(spark, tmp_path):
    head = "water wheels turn slowly " * 200
    rows = [(0, head, "en", "a", 0), (1, head + "granite " * 900, "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    a, b = (r.vector for r in QUERIES["hashing_embeddings"](spark, str(tmp_path)).collect())
    assert sum(x * y for x, y in zip(a, b, strict=True)) < 0.95


def test_entry_runs_without_the_corpus_package(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "context"
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
