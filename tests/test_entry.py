"""The driver's contract holds with and without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
WITHOUT = "import __spark_entry__ as e; q = e.queries(); assert 'screen_impact' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_imports_without_the_optional_modules(tmp_path, pipeline):
    parts = ["__spark_entry__.py", "tracelake"] + ["corpus_pipeline.py"] * (pipeline and (REPO / "corpus_pipeline.py").exists())
    for part in parts:
        subprocess.run(["cp", "-r", REPO / part, tmp_path / part], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "tracelake/llm"], check=True)
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
