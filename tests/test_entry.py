import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_a_session_and_oracles_belong_to_queries():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout) > 100


def test_entry(spark):
    import __spark_entry__

    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).count() > 0
