"""Every registered query of the document operators against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cloakframe.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    if isinstance(x, float) or getattr(getattr(x, "dtype", None), "kind", "") == "f":
        return round(float(x), 9)
    if getattr(getattr(x, "dtype", None), "kind", "") in ("i", "u"):
        return int(x)
    return bool(x) if getattr(getattr(x, "dtype", None), "kind", "") == "b" else x


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["resolve_overlaps", "resolve_overlaps_native", "overlap_warnings"])
def test_query_on_more_rows(spark, name):
    """Ties in the order of overlapping spans only occur on larger tables."""
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(c.execute(ORACLE[name]).df())
