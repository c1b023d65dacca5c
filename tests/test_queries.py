"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

registry.load()
SF = Path("/root/testdata/sf0.001")


def cell(v: object) -> str:
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, decimal.Decimal)) or type(v).__name__.startswith("float"):
        return f"{float(v) + 0.0:.8g}"
    if isinstance(v, (bool, int)) or type(v).__name__.startswith(("bool", "int")):
        return str(v if not isinstance(v, bool) else bool(v))
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, str(SF)).toPandas()
    got = got[sorted(got.columns)]
    if name not in registry.SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(registry.SQL[name]).df()
    want = want[sorted(want.columns)]
    assert list(got.columns) == list(want.columns)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))
    assert rows(got) == rows(want)
