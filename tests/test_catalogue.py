"""Every query with an oracle gives the oracle's rows on the smallest tables; the others give rows."""

from __future__ import annotations

import glob
import os

import pytest

import tempograph.plans as plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW: set[str] = set()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - SLOW))
def test_query(spark, con, tmp_path, name):
    plans.queries()[name](spark, FOLDER).write.parquet(str(tmp_path / "out"))
    con.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    assert con.execute("SELECT count(*) FROM got").fetchall()[0][0] > 0
    if name in plans.oracle_sql():
        con.execute(f"CREATE OR REPLACE TEMP TABLE want AS {plans.oracle_sql()[name]}")
        schema = lambda t: sorted(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {t})").fetchall())
        assert schema("got") == schema("want")
        cols = ", ".join(f'"{c}"' for c, _ in schema("want"))
        for a, b in (("got", "want"), ("want", "got")):
            assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
