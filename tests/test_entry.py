"""The driver's entry module: what it registers, and that optional parts may be missing."""

from __future__ import annotations

import subprocess
import sys

import pytest

from lodestone.plans import catalogue

PROGRAM = """
import sys
blocked = sys.argv[1]

class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == blocked or name.startswith(blocked + "."):
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__
names = sorted(__spark_entry__.queries())
assert set(__spark_entry__.oracle_sql()) <= set(names)
print(len(names))
"""


def registered(blocked: str) -> int:
    return int(subprocess.run([sys.executable, "-c", PROGRAM, blocked], capture_output=True, text=True, check=True).stdout)


@pytest.mark.parametrize("blocked", ["xxhash", "ahocorasick", "numpy", "lodestone.llm", "corpus_pipeline", "nothing"])
def test_engine_queries_need_no_optional_module(blocked):
    """A missing library or folder costs the queries that need it alone."""
    assert registered(blocked) >= len(catalogue.QUERIES)
