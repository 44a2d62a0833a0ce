from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_text_subpackage():
    for p in (HOME / "quillbar").rglob("*.py"):
        if "llm" not in p.relative_to(HOME / "quillbar").parts:
            assert not re.search(r"quillbar\.llm|from \.+llm", p.read_text(encoding="utf-8")), p


def test_entry_without_the_text_subpackage(tmp_path):
    code = "import sys; sys.modules['quillbar.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'p1_found' in q and 'p8_ids' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=HOME, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert set(e.oracle_sql()) <= set(q) and len(q) > 400
    assert e.entry(spark).count() > 0
