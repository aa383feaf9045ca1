"""The driver's contract holds with and without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("blocked", ["larkspan.llm", "xxhash", "corpus_pipeline", "tokenizers"])
def test_a_module_that_is_missing_costs_no_other_query(blocked):
    code = f"""
import sys
sys.modules[{blocked!r}] = None
import __spark_entry__ as entry
names = entry.queries().keys()
assert len(names) > 230 and entry.oracle_sql().keys() <= names, len(names)
assert "ret3_hybrid_search" in names
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
