"""The entry module with and without what the optional operators need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {0!r} or name == {0!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert "rolling_channel" in e.queries() and "rolling_channel" in e.oracle_sql()
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"], "optional queries"
"""


@pytest.mark.parametrize("hidden", ["tiktoken", "corpus_pipeline", "tillwatch.llm"])
def test_entry_without_the_optional_part(hidden):
    done = subprocess.run([sys.executable, "-c", HIDE.format(hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
