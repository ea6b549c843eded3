"""The registry: names, SQL for existing queries only, and that the library works without the optional subpackage."""

import subprocess
import sys

import __spark_entry__ as entry
from scholia import registry


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) > 80


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score", "rank"] and df.count() == 50


def test_without_the_optional_parts():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and e.oracle_sql(); assert not any(m.startswith('scholia.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
