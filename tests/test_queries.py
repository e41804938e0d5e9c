"""Every registered query of the library against its SQL, run by DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera import plans, registry

plans.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(x) -> str:
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        return f"{x:.5f}".replace("-0.00000", "0.00000") if isinstance(x, float) else str(x)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = con.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_minhash_finds_what_brute_force_finds(spark):
    got = {r.doc_id: r.component for r in registry.QUERIES["minhash_lsh"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    by_text: dict = {}
    for r in docs:
        by_text.setdefault(r.text, []).append(r.doc_id)
    assert all(len({got[d] for d in same}) == 1 for same in by_text.values())
