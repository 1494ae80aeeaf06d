import importlib.util
import os

import pytest

import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("quillspark.llm") and importlib.util.find_spec("corpus_pipeline"):
        assert "pipeline" in entry.queries()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 7
