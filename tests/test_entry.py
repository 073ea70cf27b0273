"""The driver's entry points, with and without the training-data folder."""

import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_entry_points_without_the_folder(monkeypatch):
    for name in ("meshwright.llm", "meshwright.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import meshwright

    monkeypatch.delattr(meshwright, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "gcn_2layer" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "k", "v"] and df.count() == 500 * 10
