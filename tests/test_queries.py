"""Every query runs; those with SQL give what DuckDB gives."""

import importlib
import os
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BLOCKS = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(rows, columns):
    return sorted(repr([None if v != v else v for v in r]) for r in ([r[c] for c in sorted(columns)] for r in rows))


@pytest.mark.parametrize("name", BLOCKS)
def test_query(spark, duck, name):
    got = [r.asDict() for r in entry.queries()[name](spark, SF).collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        want = [dict(zip(names, r)) for r in cursor.fetchall()]
        assert sorted(got[0] if got else names) == sorted(names)
        assert same(got, names) == same(want, names)
    else:
        assert got is not None


def test_entry(spark):
    assert entry.entry(spark).count() == 125


def test_entry_without_the_text_queries(monkeypatch):
    monkeypatch.setitem(sys.modules, "gridloom.llm", None)
    for name in [m for m in sys.modules if m.startswith("gridloom.llm.")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    alone = importlib.reload(entry)
    try:
        assert set(alone.queries()) == set(BLOCKS) and "op5_line_dedup" not in alone.oracle_sql()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
