"""Every registered query outside the training-data subpackage against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from pagetrail.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return bytes(x) if isinstance(x, bytearray) else x


def rows(names, found):
    return sorted((tuple(plain(r[i]) for i in names) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", ["d15_average_vectors", "d16_merge_by_word"])
def test_means_that_round_to_zero_keep_their_sign(name, spark, tmp_path):
    vecs = [(k, [(-1) ** (k + i) * 3e-6 * (i % 3) - 1e-6 * (i % 2) for i in range(64)], k % 2) for k in range(8)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got == sorted(map(repr, con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()))
    assert any("-0.0" in r for r in got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(names) == cols
    assert rows(range(len(cols)), got) == rows([names.index(c) for c in cols], want)
