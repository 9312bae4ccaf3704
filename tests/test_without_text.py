"""The log engine stands alone: without the text operators everything else imports and is listed."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(root):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"
    return subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)


def test_imports_without_text_operators(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    out = run(root)
    assert out.returncode == 0, out.stderr
    assert "high_watermark" in out.stdout.split() and not any(n.startswith("op") and n[2].isdigit() for n in out.stdout.split())


def test_imports_with_the_pipeline_alone(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    out = run(root)
    assert out.returncode == 0, out.stderr
    assert "high_watermark" in out.stdout.split() and "pipeline" not in out.stdout.split()


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "logweir")):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read()


def test_other_import_errors_are_not_swallowed(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (root / "corpus_pipeline.py").write_text("import no_such_module_anywhere\n")
    assert run(root).returncode != 0
