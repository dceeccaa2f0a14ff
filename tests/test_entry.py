import duckdb
import pytest

import __spark_entry__ as e
from tessella.plans import registry

SF = "/root/testdata/sf0.001"


def canon(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def test_entry(spark):
    assert e.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "labels", "conversations", "benchmark", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(registry.SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cur.fetchall())
