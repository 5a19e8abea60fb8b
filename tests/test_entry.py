"""The driver contract holds with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("siltline.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
"""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    found = entry.entry(spark)
    assert found.count() > 0 and found.columns == ["status", "blocks", "runs", "share"]


def test_import_without_the_corpus_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for f in (ROOT / "siltline").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "siltline.llm" not in f.read_text()
