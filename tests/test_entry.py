"""The entry module works without a session and without the optional part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def listed(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", LIST], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_queries_are_listed_before_a_session_starts():
    n, unknown, *_ = listed(ROOT)
    assert int(n) > 200 and unknown == "[]"


def test_queries_are_listed_without_the_optional_part(tmp_path):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "groundwork"), tmp_path / "groundwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    n, unknown, operators, pipeline = listed(tmp_path)
    assert int(n) > 200 and unknown == "[]" and operators == "0" and pipeline == "False"
