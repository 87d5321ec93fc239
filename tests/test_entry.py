"""The driver's entry module, with the corpus parts and without them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder) -> list[str]:
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(folder), *[p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT]])}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_the_engine_stays_without_the_corpus_parts(tmp_path):
    from panelforge.plans import registry

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for removed in ([], ["corpus_pipeline.py"], ["panelforge/llm"]):
        for x in removed:
            shutil.rmtree(copy / x) if (copy / x).is_dir() else (copy / x).unlink(missing_ok=True)
        got = set(names(copy))
        assert set(registry.QUERIES) <= got
        if removed:
            assert got == set(registry.QUERIES)


def test_an_import_error_inside_the_corpus_parts_leaves_the_engine(tmp_path):
    from panelforge.plans import registry

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    (copy / "panelforge" / "llm").mkdir(exist_ok=True)
    (copy / "panelforge" / "llm" / "registry.py").write_text("import a_package_that_is_not_there\n")
    assert set(names(copy)) == set(registry.QUERIES)
