"""The engine stands without the corpus operators and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_imports_and_runs_without_them(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for name in ("tidegauge", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "tidegauge" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q), q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr


def test_no_module_of_the_engine_names_them():
    root = Path(__file__).resolve().parents[1] / "tidegauge"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tidegauge.llm" in p.read_text()]
