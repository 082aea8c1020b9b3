"""The driver contract without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"


def names(folder):
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_stands_without_the_subpackage(tmp_path, pipeline):
    """Also where the pipeline's file is still there, or only compiled files are left of the subpackage."""
    skipped = shutil.ignore_patterns(".git", "llm", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(REPO, tmp_path / "repo", ignore=skipped)
    (tmp_path / "repo/lectern/llm/__pycache__").mkdir(parents=True)
    left = names(tmp_path / "repo")
    assert "flagship_chunks_by_language" in left and not any(n.startswith("op") or n == "pipeline" for n in left)
    here = names(REPO)
    assert left <= here and len(here - left) in (0, *range(11, 20))
