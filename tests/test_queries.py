"""Every registered query against its DuckDB SQL, on the smallest tables."""

import re

import duckdb
import pandas as pd
import pytest

from regista import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return "NULL"
    if isinstance(value, float):
        return f"{value:.6g}"
    return re.sub(r" 00:00:00$", "", str(value))


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_the_library_stands_without_the_subpackage(tmp_path):
    """In a copy without the subpackage and its pipeline everything else imports and is registered."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(catalog.__file__).parent.parent
    for path in (root / "regista").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "regista.llm" not in path.read_text()
    shutil.copytree(root / "regista", tmp_path / "regista", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) == len(QUERIES)
