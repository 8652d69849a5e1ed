"""The library without its optional part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, *args):
    return subprocess.run([sys.executable, *args], cwd=folder, capture_output=True, text=True, timeout=300)


def test_queries_and_tests_load_without_the_optional_package(tmp_path):
    copy = tmp_path / "repo"
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, copy, ignore=left_out)
    code = "from __spark_entry__ import queries, oracle_sql; q = queries(); print(len(q), any(n[:2] == 'op' or n == 'pipeline' for n in q), set(oracle_sql()) <= set(q))"
    out = run(copy, "-c", code)
    assert out.returncode == 0, out.stderr
    n, optional, known = out.stdout.split()
    assert int(n) > 150 and optional == "False" and known == "True"
    collected = run(copy, "-m", "pytest", "tests", "--collect-only", "-q")
    assert collected.returncode == 0, collected.stdout[-2000:]

    # A folder that holds left-over caches only is not the package.
    (copy / "ticklake" / "llm" / "__pycache__").mkdir(parents=True)
    assert run(copy, "-c", code).stdout.split()[1] == "False"


def test_all_test_modules_load_in_one_run():
    collected = run(ROOT, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert collected.returncode == 0, collected.stdout[-2000:]
