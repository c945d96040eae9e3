"""The entry point with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sorted(set(o) - set(q)), any(k.startswith('op') or k == 'pipeline' for k in q))"


def entry(root):
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, check=True)
    return out.stdout.split(maxsplit=2)


def test_every_oracle_has_a_query():
    n, m, rest = entry(ROOT)
    assert int(n) >= int(m) and rest.startswith("[]")


def test_queries_without_the_corpus_operators(tmp_path):
    for keep in ("with_pipeline", "without"):
        root = tmp_path / keep
        shutil.copytree(f"{ROOT}/starling", root / "starling", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{ROOT}/__spark_entry__.py", root)
        if keep == "with_pipeline":
            shutil.copy(f"{ROOT}/corpus_pipeline.py", root)
        n, m, rest = entry(root)
        assert int(n) > 70 and int(m) > 60 and rest.strip() == "[] False"
