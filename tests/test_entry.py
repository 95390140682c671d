import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_with_and_without_the_operators(tmp_path):
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copy(f"{ROOT}/__spark_entry__.py", copy)
    shutil.copytree(f"{ROOT}/ledgerlark", copy / "ledgerlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) >= 50 and set(o) <= set(q); print(len(q))"
    run = lambda folder: subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    for folder in (str(copy), ROOT):
        done = run(folder)
        assert done.returncode == 0, done.stderr


def test_flagship(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        rows = e.entry(spark).collect()
        assert rows and set(rows[0].asDict()) == {"rule", "findings", "invoices"}
