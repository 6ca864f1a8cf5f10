"""The entry with and without the training-data operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from presswork import plans, registry  # noqa: F401  plans register themselves

ROOT = Path(__file__).resolve().parents[1]
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("gone", [["presswork/llm"], ["presswork/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_operators(tmp_path, gone):
    for name in ("presswork", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        else:
            (tmp_path / name).unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    queries, oracles = json.loads(out.splitlines()[-1])
    assert set(queries) == set(registry.QUERIES) and set(oracles) == set(registry.ORACLES)


def test_twins_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
