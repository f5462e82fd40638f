"""The library works without the operators for training data."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SHOW = """
import importlib, sys
import __spark_entry__ as e
print(len(e.queries()), any(n == "pipeline" or n[:2] == "op" and n[2].isdigit() for n in e.queries()))
"""


def shown(folder) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()[-2:]


def copied(to, *left_out):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(REPO, to, ignore=lambda d, names: {*skip(d, names), *(n for n in names if os.path.relpath(os.path.join(d, n), REPO) in left_out)})
    return to


def test_without_the_folders(tmp_path):
    """With corpus_pipeline.py left in place or not."""
    folders = [os.path.join("vacanta", "llm"), os.path.join("tests", "llm")]
    without = shown(copied(tmp_path / "a", *folders))
    assert without == shown(copied(tmp_path / "b", *folders, "corpus_pipeline.py"))
    assert without[1] == "False" and int(without[0]) > 60


def test_nothing_else_imports_them():
    for folder, _, names in os.walk(os.path.join(REPO, "vacanta")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                text = open(os.path.join(folder, name)).read()
                assert "vacanta.llm" not in text and "corpus_pipeline" not in text, name
