"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quire import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, str)):
        return x
    return float(f"{float(x):.8g}")


def key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, bool) else int(x)) if x is not None else (True, "", 0) for x in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        vals = [plain(r[i]) for i in order]
        out.append(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in vals))
    return sorted(out, key=key)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    frame = catalog.queries()[name](spark, SF)
    got = rows_of(frame.columns, frame.collect())
    cursor = oracle.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    assert sorted(frame.columns) == sorted(names)
    assert got == want


#: Queries that SQL cannot express, and where they are held against brute force.
BY_HAND = {"document_numbers", "markdown_blocks", "matched_elements", "matched_tables", "text_metrics"}


def test_queries_without_sql_are_tested_by_hand():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == BY_HAND


def test_the_contract_lists_everything(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
