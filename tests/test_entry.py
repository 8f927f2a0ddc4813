import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_names_and_sql():
    names = entry.queries()
    assert {"doc_tokens", "search_top10", "suggest", "html_text"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["rank", "doc_id", "score"]


def test_other_import_errors_are_not_hidden(tmp_path):
    """Only a missing subpackage is passed over."""
    code = "import __spark_entry__ as e\nprint(e._optional('no_such_module_at_all'))\ntry:\n    e._optional('tests_broken_module')\nexcept ModuleNotFoundError as x:\n    print(x.name)"
    (tmp_path / "tests_broken_module.py").write_text("import really_missing\n")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={"PYTHONPATH": f"{tmp_path}:{':'.join(sys.path)}", "PATH": "/usr/bin:/bin"}, timeout=60)
    assert out.stdout.split() == ["None", "really_missing"], out.stderr


def test_the_rest_works_without_the_subpackage(tmp_path):
    """A copy without the subpackage and its tests (with and without the pipeline) still has its own queries and SQL."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    code = "import sys\nsys.path.insert(0, sys.argv[1])\nimport __spark_entry__ as e, quern.registry as r\nassert set(e.queries()) == set(r.QUERIES) and set(e.oracle_sql()) == set(r.ORACLE_SQL)\nassert 'quern.llm' not in sys.modules\nprint('whole', e.__file__)"
    for name, drop in (("a", []), ("b", ["corpus_pipeline.py"])):
        copy = shutil.copytree(ROOT, tmp_path / name, ignore=skip)
        for x in drop:
            (copy / x).unlink()
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", code, str(copy)], capture_output=True, text=True, env=env, cwd=tmp_path, timeout=120)
        assert out.stdout.split() == ["whole", str(copy / "__spark_entry__.py")], out.stderr
