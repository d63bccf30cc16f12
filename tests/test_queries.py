"""Every registered query with a SQL twin against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from lexweave.plans import catalogue, cells, stored

QUERIES, ORACLES = catalogue.QUERIES | stored.QUERIES | cells.QUERIES, catalogue.ORACLES | stored.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = oracle.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in result.fetchall()]
    assert rounded([[r[c] for c in columns] for r in df.collect()]) == rounded(want)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["pos_l", "pos_r", "n", "p"] and df.count() > 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_train_grid_has_every_seed(spark):
    assert {r["seed"] for r in QUERIES["train_grid"](spark, SF).select("seed").distinct().collect()} == {0, 1, 2}


def test_rows_only_queries(spark):
    assert QUERIES["unigram_em"](spark, SF).count() > 100
    assert QUERIES["train_grid"](spark, SF).count() > 1000
    merges = QUERIES["bpe_merges_batched"](spark, SF).collect()
    assert [(r["l"], r["r"], r["n"]) for r in merges][:8] == [(r["l"], r["r"], r["n"]) for r in QUERIES["bpe_merges_k8"](spark, SF).orderBy("rank").collect()]
