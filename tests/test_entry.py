"""The entry works on a copy of the repository from which the optional package was deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def listed(folder: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True)
    return done.stdout.split()


def copied(folder: Path, *left_out: str) -> Path:
    shutil.copytree(ROOT / "adjudica", folder / "adjudica", ignore=shutil.ignore_patterns(*left_out))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and (ROOT / name).exists():
            shutil.copy(ROOT / name, folder / name)
    return folder


def test_entry_works_without_the_optional_package(tmp_path):
    for k, left_out in enumerate((["llm"], ["llm", "corpus_pipeline.py"])):
        queries, oracles, pipeline = listed(copied(tmp_path / str(k), *left_out))
        assert int(queries) > 80 and int(oracles) > 60
        assert pipeline == "False"
