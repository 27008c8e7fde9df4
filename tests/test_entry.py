"""The entry module without the training-data subpackage."""

import subprocess
import sys

HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "tabflow.llm" or name.startswith("tabflow.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())
assert not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in e.queries())
"""


def test_entry_works_without_the_subpackage():
    from pathlib import Path
    subprocess.run([sys.executable, "-c", HIDE], check=True, cwd=Path(__file__).parent.parent, timeout=120)
