import duckdb
import pytest

from loomseq import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, D)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    columns = want.columns
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), columns)


def test_curve_ends(spark):
    rows = catalog.queries()["doubling_curve"](spark, D).orderBy("gen").collect()
    assert rows[-1]["ranks"] == rows[-1]["nodes"] > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
