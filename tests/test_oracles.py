import duckdb
import pytest

from loomgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, order):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in (r[i] for i in order)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    made = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLES[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(made.columns) == sorted(theirs)
    columns = sorted(theirs)
    assert plain(made.collect(), [made.columns.index(c) for c in columns]) == plain(cur.fetchall(), [theirs.index(c) for c in columns])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).schema


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 and set(e.oracle_sql()) <= set(e.queries())
