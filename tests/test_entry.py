"""The driver's contract, and that the library stands without the llm subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_entry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert __spark_entry__.entry(spark).count() == 10


def test_nothing_else_imports_llm():
    for path in (ROOT / "orrery").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"orrery\.llm|from \.+llm", path.read_text()), path


def test_imports_without_llm(tmp_path):
    code = "import sys; sys.modules['orrery.llm'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q), sorted(q); assert len(q) > 60; e.oracle_sql()"
    (tmp_path / "orrery").mkdir()
    for path in (ROOT / "orrery").iterdir():
        if path.name not in ("llm", "__pycache__"):
            (tmp_path / "orrery" / path.name).symlink_to(path)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code.replace("sys.modules['orrery.llm'] = None; ", ""), str(tmp_path)], check=True, cwd=tmp_path)
