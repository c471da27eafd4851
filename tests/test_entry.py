"""The driver's contract, with and without the removable subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "shape" in out.columns


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_the_subpackage(tmp_path):
    for p in ("formulake", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "formulake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); import re; assert not any(re.match(r'op[0-9]', n) or n == 'pipeline' for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 60, out.stderr
