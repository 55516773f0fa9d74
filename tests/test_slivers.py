"""Kept time against the oracle where pieces of one microsecond are left between cuts."""

from __future__ import annotations

import datetime

import numpy as np

import tempograph.plans as plans


def test_unify_kept(spark, tmp_path):
    import duckdb

    rng, day = np.random.default_rng(3), datetime.datetime(2024, 1, 1)
    kinds = ["click", "purchase", "view", "signup"]
    rows = []
    for i in range(1600):
        kind = kinds[rng.integers(4)]
        # times of 0 to 120 in microseconds, cuts of 1 to 12, zones that cut now and then, else ramps
        value = float(rng.integers(1, 13)) / 20_000 if kind == "click" else float(rng.choice([200.0, 334.0])) if rng.random() < 0.02 else 1e-4 * float(rng.integers(1, 5))
        rows.append((i, day + datetime.timedelta(microseconds=10_000 * int(rng.integers(0, 120))), int(i % 40), kind, value, '{"k": 1}'))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(f"SELECT session_id, kept FROM ({plans.oracle_sql()['unify_kept']})").fetchall())
    assert {r.session_id: r.kept for r in plans.queries()["unify_kept"](spark, str(tmp_path)).collect()} == want
