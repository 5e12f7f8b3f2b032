"""Each corpus query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest
import xxhash

from markloom.llm import xxh64
from markloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == expected


def test_hash_in_sql():
    texts = ["", *("aé b"[k % 4] * k + "x" for k in range(1, 90))]
    con = duckdb.connect()
    con.execute("CREATE TABLE u AS SELECT unnest($1) AS g", [texts])
    got = dict(con.execute(f"WITH {xxh64.ctes('u', 42)} SELECT g, h FROM xxh64").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
