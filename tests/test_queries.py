"""Every registered query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from lexispark.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(value(x) for x in v)
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(names, want.fetchall())


def test_entry_imports_without_the_training_data_parts(tmp_path, spark, data):
    """Without the subpackage and the pipeline the entry still imports and gives the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lexispark", tmp_path / "lexispark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}
    )


def test_entry_survives_training_data_parts_that_do_not_import(tmp_path):
    """An import that fails inside the subpackage leaves the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lexispark", tmp_path / "lexispark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lexispark" / "llm").mkdir()
    (tmp_path / "lexispark" / "llm" / "__init__.py").write_text("")
    (tmp_path / "lexispark" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
