"""Every analytics query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from varsight.plans import catalog

SF = Path("/root/testdata/sf0.001")


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT":
        return None
    if hasattr(v, "year"):
        return str(v)[:19].replace(" 00:00:00", "")
    return float(v) if isinstance(v, float) else v


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(_plain(v) for v in r) for r in df.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = _rows(catalog.queries()[name](spark, str(SF)).toPandas())
    want = _rows(con.execute(catalog.oracle_sql()[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, abs=2e-8, rel=1e-8))
