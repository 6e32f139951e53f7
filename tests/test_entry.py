import subprocess
import sys
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_imports_without_spark():
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "q = E.queries(); o = E.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))" % ROOT)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "status" in df.columns and "ticket_id" in df.columns
