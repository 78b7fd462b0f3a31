"""The driver's entry module: names, SQL, and life without the subpackage of training-data operators."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill.plans import catalog

ROOT, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    """A copy without llm and corpus_pipeline imports and keeps the library's queries."""
    for name in ("__spark_entry__.py", "corpusmill"):
        if (ROOT / name).is_dir():
            for p in (ROOT / name).rglob("*.py"):
                if "llm" not in p.parts:
                    (tmp_path / p.relative_to(ROOT)).parent.mkdir(parents=True, exist_ok=True)
                    (tmp_path / p.relative_to(ROOT)).write_text(p.read_text())
        else:
            (tmp_path / name).write_text((ROOT / name).read_text())
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(__import__('corpusmill.plans.catalog', fromlist=['x']).QUERIES))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "True"


def test_without_a_library_of_the_subpackage():
    """Where a library that only the subpackage needs is missing, the other queries are there."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()) == len(__import__('corpusmill.plans.catalog', fromlist=['x']).QUERIES))"
    core = "import sys; sys.modules['corpusmill.functions.text'] = None; import __spark_entry__"
    run = lambda c: subprocess.run([sys.executable, "-c", c], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True)
    if (ROOT / "corpusmill/llm").is_dir():
        assert run(code).stdout.strip() == "True"
    assert run(core).returncode != 0, "a fault of the library itself is not hidden"


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = catalog.QUERIES[name](spark, DATA)
    found = con.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rounded(tuple(r) for r in df.select(*columns).collect()) == rounded(found.fetchall())
