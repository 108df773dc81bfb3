import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 30


def test_the_core_does_without_the_subpackage():
    code = """
import sys
sys.modules["tributary.llm"] = None
import __spark_entry__ as e
import tributary.api, tributary.cli, tributary.streaming.fusion, tributary.plans.answer
assert e.queries() and not [q for q in e.queries() if q.startswith("p1_")]
assert not [m for m in sys.modules if m.startswith("tributary.llm.")]
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"query_id", "key", "engines", "positions", "score"} <= set(df.columns)
    assert df.limit(1).count() == 1
