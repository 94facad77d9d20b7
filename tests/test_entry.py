"""The entry stands without the optional subpackage, whatever else is there."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT

SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def copy_without_subpackage(target, keep_pipeline):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, target, ignore=skip)
    return target


def counts(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return list(map(int, out.stdout.split()))


def test_entry_without_the_subpackage(tmp_path):
    from fleetlens.plans import all_suites

    want = sum(len(s.builders) for s in all_suites())
    for i, keep_pipeline in enumerate((True, False)):
        n, with_sql, optional = counts(copy_without_subpackage(tmp_path / str(i), keep_pipeline))
        assert (n, optional) == (want, 0) and 0 < with_sql <= n


def test_an_emptied_subpackage_is_left_out(tmp_path):
    folder = copy_without_subpackage(tmp_path / "repo", True)
    (folder / "fleetlens" / "llm").mkdir()
    assert counts(folder)[2] == 0
