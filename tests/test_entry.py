"""The entry must import, and keep its other queries, where the optional corpus operators are absent."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["tidewatch/llm"], ["tidewatch/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(g) for g in gone])
    shutil.copytree(ROOT, copy, ignore=skip)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, set(s) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    n, pipeline, covered = done.stdout.split()[-3:]
    assert int(n) > 100 and pipeline == "False" and covered == "True"
