"""The registered queries without the folders of the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), sorted(names)
assert set(e.oracle_sql()) <= names and "w07_weekly_model_features" in names
"""


def test_the_library_imports_without_the_text_operators(tmp_path):
    for pipeline in (False, True):  # with the folder alone gone, and with the pipeline too
        copy = tmp_path / str(pipeline)
        shutil.copytree(ROOT / "pitcast", copy / "pitcast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(ROOT / "__spark_entry__.py", copy)
        if pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", copy)
        done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
