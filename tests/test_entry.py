import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(names) > 50


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_optional_package():
    for path in (ROOT / "folioscan").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("folioscan.llm", "corpus_pipeline")) for n in names), path
