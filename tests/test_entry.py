"""The entry module without the optional part, in whatever state that is."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCK = """
import importlib.abc, sys
class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.split(".")[0] == {name!r} or name == {name!r}:
            raise {error}("no module " + name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
print(len(e.queries()), sum(q.startswith("op") for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "skarn.llm", "corpus_pipeline"])
@pytest.mark.parametrize("error", ["ModuleNotFoundError", "ImportError"])
def test_queries_stay_when_the_optional_part_cannot_be_imported(name, error):
    done = subprocess.run([sys.executable, "-c", BLOCK.format(name=name, error=error)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, optional, known = done.stdout.split()
    assert int(n) >= 90 and optional == "0" and known == "True", done.stderr
