"""The entry file with and without the optional corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent
SHOWN = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def _copy(to: Path, *left_out: str) -> Path:
    for name in ("__spark_entry__.py", "bench.py", "check_oracles.py", "corpus_pipeline.py"):
        if name not in left_out and (HOME / name).exists():
            shutil.copy(HOME / name, to / name)
    ignored = shutil.ignore_patterns("__pycache__", *left_out)
    shutil.copytree(HOME / "tenderloom", to / "tenderloom", ignore=ignored)
    shutil.copytree(HOME / "tests", to / "tests", ignore=ignored)
    return to


def _run(folder: Path, code: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_imports_without_corpus_operators(tmp_path, left_out):
    from tenderloom.plans.catalog import CATALOG

    folder = _copy(tmp_path, *left_out)
    done = _run(folder, SHOWN + "; import bench, check_oracles")
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(CATALOG)), str(sum(e.sql is not None for e in CATALOG.values())), "False"]
    found = subprocess.run(
        [sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"],
        cwd=folder, capture_output=True, text=True, timeout=300,
    )
    assert found.returncode == 0, found.stdout[-2000:]


def test_other_missing_modules_are_not_hidden(tmp_path):
    folder = _copy(tmp_path, "llm")
    (folder / "tenderloom" / "llm").mkdir()
    (folder / "tenderloom" / "llm" / "__init__.py").write_text("")
    (folder / "tenderloom" / "llm" / "catalog.py").write_text("import no_such_module")
    assert "no_such_module" in _run(folder, SHOWN).stderr
