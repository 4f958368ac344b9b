"""The library without its corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "speaker_stats" in q and "pipeline" not in q and not any(k.startswith("op") and k[2].isdigit() for k in {*q, *o})
assert set(o) <= set(q)
"""


def copied(to, *left_out):
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out))
    return to


def test_queries_without_the_folders(tmp_path):
    for name, left_out in (("folders", ["llm"]), ("all", ["llm", "corpus_pipeline.py"])):
        folder = copied(tmp_path / name, *left_out)
        got = subprocess.run([sys.executable, "-c", RUN], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
        assert got.returncode == 0, got.stderr
