"""Three walls: no data in prompts, verdicts only from validated claims, no dynamic SQL."""

import ast
import pathlib

PACKAGE = pathlib.Path(__file__).parent.parent / "claimcheck"
FILES = [p for p in PACKAGE.rglob("*.py") if "llm" not in p.parts]


def _calls(path):
    return [n for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Call)]


def test_no_eval_and_no_sql_text_is_run():
    for p in FILES:
        for c in _calls(p):
            name = c.func.attr if isinstance(c.func, ast.Attribute) else getattr(c.func, "id", "")
            assert name not in ("eval", "exec", "selectExpr", "expr"), p
            assert not (name == "sql" and isinstance(c.func, ast.Attribute)), p


def test_clients_never_see_data():
    tree = ast.parse((PACKAGE / "claims.py").read_text())
    assert not any(isinstance(n, ast.ImportFrom) and n.module and "dataset" in n.module for n in ast.walk(tree))


def test_the_rest_does_not_import_llm():
    for p in FILES:
        assert "llm" not in {x for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom) and n.module for x in n.module.split(".")}, p
