import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_the_subpackage():
    code = "import sys; sys.modules['weftlake.llm'] = None; import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and 'p8_ids' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_core_does_not_name_the_subpackage():
    for path in (ROOT / "weftlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "weftlake.llm" not in path.read_text(), path
