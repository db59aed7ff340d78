"""Every query of the catalogue against its SQL, in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from formloom import catalogue_queries as c

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return db


def test_names():
    assert set(c.QUERIES) == set(c.ORACLES)


@pytest.mark.parametrize("name", c.QUERIES)
def test_against_sql(spark, duck, name):
    df = c.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.execute(c.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert order(tuple(r[x] for x in columns) for r in df.collect()) == order(tuple(r[names.index(x)] for x in columns) for r in rel.fetchall())


def test_library_does_not_import_the_subpackage():
    import subprocess
    import sys

    code = "import sys, formloom.job, formloom.catalogue_queries, formloom.streaming.landing; assert not any(m.startswith('formloom.llm') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_core_without_what_the_subpackage_needs():
    """Whatever of the subpackage can't be imported: the entry and the other queries stay."""
    import subprocess
    import sys

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for gone in ("public_tokenizers", "formloom.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) == {len(c.QUERIES)}, len(q); assert set(e.oracle_sql()) <= set(q) and callable(e.entry)"
        assert subprocess.run([sys.executable, "-c", code], cwd=home).returncode == 0
