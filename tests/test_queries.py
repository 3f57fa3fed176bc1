"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tributary import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    want = oracle.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())


def test_queries_without_sql(spark):
    pieces = registry.QUERIES["utf8_split"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole: dict = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        assert len(r["text"].encode()) <= 1000
        whole[r["doc_id"]] = whole.get(r["doc_id"], "") + r["text"]
    assert whole == texts
    slugs = {r["doc_id"]: r["slug"] for r in registry.QUERIES["slug_key"](spark, SF).collect()}
    assert slugs == {r["doc_id"]: r["slug"] for r in registry.QUERIES["nfkc_key"](spark, SF).collect()}
