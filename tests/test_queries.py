"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

from briefloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, database, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    found = database.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert df.count() >= 0 and df.columns


def test_order_of_rows_does_not_matter(spark):
    from briefloom.operators import boards
    from briefloom.sources.adapters import scored_items

    items = scored_items(spark, FOLDER)
    shuffled = items.repartition(7, "item")
    assert sorted(map(str, boards.boards(items).collect())) == sorted(map(str, boards.boards(shuffled).select(boards.boards(items).columns).collect()))
