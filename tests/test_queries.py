"""Every registered query against its SQL in DuckDB, on the smallest test data."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(x):
        if isinstance(x, float):
            return "NaN" if math.isnan(x) else f"{x + 0.0:.6f}"
        return str(x)

    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    assert plain([tuple(r) for r in frame.collect()], frame.columns) == plain(found.fetchall(), names)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_missing_modules_are_told_from_broken_ones(monkeypatch):
    def absent(name):
        raise ModuleNotFoundError("gone", name=name)

    monkeypatch.setattr(entry.importlib, "import_module", lambda m: absent(m.removesuffix(".queries")))
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    monkeypatch.setattr(entry.importlib, "import_module", lambda m: absent("numpy"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
