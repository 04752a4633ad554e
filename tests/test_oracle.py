"""Every query with an SQL equivalent gives the same rows in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from checks import queries
from checks.queries import CHECKS
from seriesloom.params import BoostParams
from tools.compare import sorted_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", [n for n, c in CHECKS.items() if c.sql])
def test_same_rows(spark, db, name, monkeypatch):
    # What must hold of a trained model holds after a few rounds; the registered queries fit all of them.
    monkeypatch.setattr(queries, "BOOST", BoostParams(rounds=4))
    df = CHECKS[name].run(spark, FOLDER)
    result = db.execute(CHECKS[name].sql)
    expected = sorted_rows([d[0] for d in result.description], result.fetchall())
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == expected
