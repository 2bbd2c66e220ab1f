import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"


def _copy(tmp_path):
    shutil.copytree(ROOT / "framewright", tmp_path / "framewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def _run(code, folder):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


@pytest.mark.parametrize("leftover", [False, True])
def test_entry_works_without_the_subpackage(tmp_path, leftover):
    folder = _copy(tmp_path)
    if leftover:  # an empty folder is a namespace package
        (folder / "framewright/llm/__pycache__").mkdir(parents=True)
        (folder / "corpus_pipeline.py").write_text("import framewright.llm.registry\n")
    got = _run(COUNT, folder)
    assert got.returncode == 0, got.stderr
    assert got.stdout.split()[1] == "False"


def test_entry_does_not_hide_a_missing_library(tmp_path):
    folder = _copy(tmp_path)
    (folder / "corpus_pipeline.py").write_text("import no_such_library\n")
    got = _run(COUNT, folder)
    assert got.returncode != 0 and "no_such_library" in got.stderr
