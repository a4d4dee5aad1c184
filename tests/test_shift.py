"""shift_calibrator against its SQL on one thread of DuckDB: its SQL takes a band's mean score twice, and on several threads the two differ."""

import duckdb
import pytest

from kindred.plans import relations


def test_shift_calibrator_is_its_sql_on_one_thread(spark, data):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = {r[:2]: r[2] for r in con.execute(relations.C.oracles["shift_calibrator"]).fetchall()}
    got = {tuple(r)[:2]: r["q"] for r in relations.C.queries["shift_calibrator"](spark, data).collect()}
    assert got == pytest.approx(want, abs=2e-6)
