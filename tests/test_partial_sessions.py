"""Queries over sessions of 100 sentences give their oracle's rows where the last sessions are cut short."""

from __future__ import annotations

import numpy as np
import pytest

import tempograph.plans as plans

QUERIES = [
    "gap_scores",
    "smooth3",
    "depth_scores",
    "boundaries_at_scale",
    "union_distinct",
    "fixed_chunks",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Sessions of 100, 56, 7 and 6 sentences."""
    path, rng = tmp_path_factory.mktemp("partial"), np.random.default_rng(5)
    rows = [(100 * d + i, [float(x) for x in rng.normal(size=64)]) for d, n in enumerate((100, 56, 7, 6)) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("name", QUERIES)
def test_partial(spark, folder, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    plans.queries()[name](spark, folder).write.parquet(str(tmp_path / "out"))
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    con.execute(f"CREATE TABLE want AS {plans.oracle_sql()[name]}")
    cols = ", ".join(f'"{r[0]}"' for r in con.execute("DESCRIBE want").fetchall())
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
