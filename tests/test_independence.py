"""The library works without the corpus subpackage, and imports nothing of it."""

import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_without_the_corpus_folders(tmp_path):
    keep = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)


def test_nothing_else_imports_it():
    for p in (ROOT / "helixframe").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(import|from)\s+\S*\bllm\b", p.read_text()), p


def test_other_import_errors_are_raised(tmp_path):
    """Only a missing subpackage is tolerated, not one that is broken."""
    keep = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)
    llm = tmp_path / "repo" / "helixframe" / "llm"
    llm.mkdir(exist_ok=True)
    (llm / "__init__.py").write_text("")
    (llm / "queries.py").write_text("import no_such_module_at_all\n")
    r = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert r.returncode and "no_such_module_at_all" in r.stderr
