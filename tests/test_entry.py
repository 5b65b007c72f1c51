"""The driver's entry file with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


def counts(folder: Path) -> list[int]:
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    return [int(x) for x in out.stdout.split()]


def test_entry_without_the_training_data_part(tmp_path):
    core = []
    for gone in (["partigrid/llm"], ["partigrid/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]):
        copy = tmp_path / str(len(core))
        copy.mkdir()
        shutil.copytree(ROOT / "partigrid", copy / "partigrid", ignore=shutil.ignore_patterns("__pycache__"))
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, copy / name)
        for name in gone:
            path = copy / name
            if path.is_dir():
                shutil.rmtree(path)
            elif path.exists():
                path.unlink()
        core.append(counts(copy))
    assert core[0] == core[1] and core[0][2] == 0
    assert core[2][0] - core[2][2] == core[0][0]


def test_nothing_outside_imports_the_training_data_part():
    for path in (ROOT / "partigrid").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "partigrid.llm" not in path.read_text()
