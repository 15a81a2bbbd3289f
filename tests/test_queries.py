"""Every registered query: its rows equal those of its SQL in DuckDB, or at least it runs."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from parchment.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        return bool(v) if isinstance(v, bool) or type(v).__name__ == "bool" else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    return sorted(repr([one(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_corpus_operators(tmp_path):
    """What is left still imports when the corpus operators and their pipeline are gone."""
    import shutil

    root = Path(importlib.util.find_spec("parchment").origin).parents[1]
    shutil.copytree(root / "parchment", tmp_path / "parchment", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(registry.QUERIES)), "False"]
