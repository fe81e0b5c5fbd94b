"""Queries of the operators that have SQL give the rows that DuckDB gives; planted near vectors too, as the tables have none."""

import duckdb
import numpy as np
import pytest

from ramify.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want, df = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(want.columns, want.fetchall())


def test_planted_vectors(spark, tmp_path):
    r = np.random.default_rng(3)
    base = r.standard_normal((200, 32))
    x = np.concatenate([base, base[:60] + 0.05 * r.standard_normal((60, 32)), np.repeat(base[70:71], 20, 0) + 0.02 * r.standard_normal((20, 32)), base[80:85]]).astype(np.float32)
    spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want, df = con.sql(queries.ORACLE_SQL["op10_embedding_dedup"]), queries.op10_embedding_dedup(spark, str(tmp_path))
    got = rows_of(df.columns, map(tuple, df.collect()))
    assert got == rows_of(want.columns, want.fetchall()) and sum(x[2] for x in got) > 400
