import pathlib
import re
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_operators():
    for f in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", f.read_text()), f


def test_entry_imports_without_the_corpus_operators(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=to, env={"PYTHONPATH": str(to), "PATH": "/usr/bin:/bin"}, check=False).returncode == 0
