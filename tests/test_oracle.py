"""Every registered query equals its independent SQL statement (DuckDB)."""

import os

import pytest

import __spark_entry__ as ent
from periodlens.plans import verify
from periodlens.plans import QUERIES as CATALOG

SF = os.environ.get("PERIODLENS_TEST_SF", "/root/testdata/sf0.001")
# the library's own queries; the optional training-data queries have their own tests
QUERIES = CATALOG
SQLS = {k: v for k, v in ent.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return verify.duck(SF)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(SQLS) and set(QUERIES) <= set(ent.queries())
    assert len(QUERIES) >= 69


@pytest.mark.parametrize("name", sorted(SQLS))
def test_oracle_fits_in_a_view(con, name):
    con.execute(f"CREATE OR REPLACE TEMP VIEW v_{name} AS {SQLS[name]}")
    con.execute(f"SELECT COUNT(*) FROM v_{name}").fetchall()


def test_entry_without_the_optional_part(tmp_path):
    """The registered library queries do not need the training-data operators or the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(ent.__file__))
    shutil.copytree(os.path.join(root, "periodlens"), tmp_path / "periodlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.split() == [str(len(QUERIES)), "True"], out.stderr[-500:]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, built, name):
    ok, msg = verify.compare(spark, con, name, SF, {name: lambda _, sf: built(name)}, SQLS)
    assert ok, msg


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.columns[:3] == ["platform", "store_id", "metric"]
    assert df.count() >= 0


SPARK_TO_SQL = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER",
                "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_types_match_oracle(con, built, name):
    df = built(name)
    got = {f.name: SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString())
           for f in df.schema.fields}
    rel = con.sql(SQLS[name])
    want = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert got == want
