"""Every registered query against its SQL."""

import os

import pytest

from descra import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    import pandas as pd

    df = df[sorted(df.columns)]
    text = lambda v: "null" if pd.isna(v) else repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)
