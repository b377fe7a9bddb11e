"""Every registered query with SQL gives the rows that DuckDB gives; the others give rows."""

import duckdb
import pytest

from tests.conftest import DATA
from weftline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([tuple(r[k] for k in at) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry_module_without_the_optional_parts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["token", "freq"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
