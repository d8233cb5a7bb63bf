"""The entry points, with the corpus subpackage and without."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["part", "n", "xmin", "ymin", "xmax", "ymax"] and df.agg({"n": "sum"}).first()[0] == 150


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e, geoloom.queries as q; assert set(e.queries()) == set(q.QUERIES) and e.oracle_sql() == q.ORACLE_SQL"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "geoloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "geoloom.llm" not in path.read_text(), path
