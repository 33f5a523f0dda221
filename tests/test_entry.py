"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, canonical, kind

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES and not n.startswith("op")])
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    assert {c: kind(t) for c, t in df.dtypes} == {d[0]: kind(str(d[1])) for d in cur.description}
    place = [names.index(c) for c in cols]
    want = sorted(repr([canonical(r[i]) for i in place]) for r in cur.fetchall())
    assert sorted(repr([canonical(r[c]) for c in cols]) for r in df.collect()) == want


def test_the_rest_works_without_the_training_data_part(monkeypatch):
    """A missing module, or one that something is missing for, takes only its own queries away."""
    def missing(name):
        raise ModuleNotFoundError(name)

    monkeypatch.setattr(entry, "import_module", missing)
    names = set(entry.queries())
    assert names == {n for n in QUERIES if not n.startswith("op") and n != "pipeline"}
    assert set(entry.oracle_sql()) <= names
