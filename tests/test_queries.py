"""Every core query with SQL gives the same rows as DuckDB at the smallest scale."""

import os

import pytest

from spanloom.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(frame, names):
    def one(v):
        return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[names].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, D).toPandas()
    assert len(got)
    if name in SQL:
        import duckdb

        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
        want = c.sql(SQL[name]).df()
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        assert shown(got, names) == shown(want, names)
