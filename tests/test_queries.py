"""Every query of the library against its SQL, on the smallest tables."""

import datetime as dt

import duckdb
import pytest

from keelstone import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


def canonical(names, rows):
    plain = lambda v: v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else v
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    got = canonical(df.columns, df.collect())
    cur = duck.execute(Q.oracles()[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(names, cur.fetchall())


def test_registry_without_training_part(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith(("keelstone.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert set(entry.queries()) == set(Q.queries()) and set(entry.oracle_sql()) == set(Q.oracles())
    assert sys.modules
