"""The driver's contract, also without the language-model subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "id", "score", "rank"]
    assert found.count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "tarnwell", tmp_path / "tarnwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not [n for n in e.queries() if n.startswith('op1') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_outside_imports_llm():
    for path in (ROOT / "tarnwell").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tarnwell").parts:
            assert "tarnwell.llm" not in path.read_text(), path


def test_a_missing_package_costs_only_its_operators():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert len(e.queries()) > 250 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
