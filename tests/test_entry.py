import subprocess
import sys


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["channel", "split", "n"]
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_import_needs_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 50"], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_works_without_the_llm_folder(tmp_path):
    import shutil

    root = __file__.rsplit("/tests/", 1)[0]
    shutil.copytree(f"{root}/textcurate", tmp_path / "textcurate", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'split_counts' in q and not any(x.startswith('op') for x in q)"], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
