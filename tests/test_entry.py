"""What is left when the optional text part cannot be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {name!r}:
            raise ImportError("no " + name, name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as E
keys = set(E.queries())
assert len(keys) > 70 and not any(k.startswith("op") and k[2].isdigit() for k in keys) and "pipeline" not in keys
assert set(E.oracle_sql()) <= keys
"""


@pytest.mark.parametrize("name", ["ahocorasick", "public_tokenizers", "regex", "corpus_pipeline"])
def test_other_queries_stand_without_the_text_part(name):
    subprocess.run([sys.executable, "-W", "ignore", "-c", CODE.format(name=name)], cwd=ROOT, check=True, timeout=120)
