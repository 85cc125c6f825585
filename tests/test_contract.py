import ast
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lexigrid.plans.oracles import ORACLES
from lexigrid.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent


def rows(values):
    clean = [tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in values]
    return sorted(clean, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = rows(tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall())
    got = rows(tuple(r) for r in df.collect())
    spark.catalog.clearCache()
    assert got == expected
    assert got[1:] != expected, "the comparison must see a missing row"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_layers():
    """The core imports neither models nor the training-data operators; those are imported by nothing else."""
    for path in (ROOT / "lexigrid").rglob("*.py"):
        own = path.relative_to(ROOT / "lexigrid").parts
        nodes = list(ast.walk(ast.parse(path.read_text())))
        names = {n.module or "" for n in nodes if isinstance(n, ast.ImportFrom)} | {a.name for n in nodes if isinstance(n, ast.Import) for a in n.names}
        if own[0] != "llm":
            assert not any(n.startswith("lexigrid.llm") for n in names), path
        if own[0] in {"functions", "operators", "sources"}:
            assert not any(n in {"lexigrid.providers", "lexigrid.plans.engine"} for n in names), path


def test_entry_works_without_the_training_data_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "lexigrid", tmp_path / "lexigrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
