import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p3_found", "cooldown_log", "near_dup_pairs"} <= set(entry.queries())


def test_nothing_imports_the_optional_subpackage():
    for path in (ROOT / "sightline").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("sightline.llm") for n in names), path


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
