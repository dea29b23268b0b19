"""Every registered query of the media operators against its SQL, on whole tables."""

import duckdb
import pandas as pd
import pytest

from frametide.plans import catalogue as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(str(round(float(x), 5) + 0.0) if isinstance(x, float) or hasattr(x, "is_integer") else str(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got)
    assert canonical(got.astype({c: float for c in got if got[c].dtype.kind in "if"})) == canonical(want.astype({c: float for c in want if want[c].dtype.kind in "if"}))


def test_entry(spark):
    assert registry.flagship(spark, SF).count() > 0
