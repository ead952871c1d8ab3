import os

import duckdb
import pytest

import __spark_entry__ as entry
from orelens.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5


def test_names_and_oracles_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["class_areas", "feature_stats", "lee_filter", "majority_filter", "per_class_metrics", "point_discards", "sieve", "glcm_tile", "validation_summary"])
def test_some_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    res = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    df = catalog.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    rows = lambda rs: sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rs)
    assert rows(df.select(*names).collect()) == rows(res.fetchall())
