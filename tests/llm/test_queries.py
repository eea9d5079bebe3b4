import importlib
import time

import pytest

import __spark_entry__ as entry
from cellweave.llm import queries
from cellweave.llm.common import stored
from tests.compare import compare, duck


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, small, name):
    assert compare(queries.QUERIES[name](spark, small), duck(small), queries.SQL[name]) is None


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14)) and "pipeline" in names


def test_entry_without_the_subpackage(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError(name=name if name == "corpus_pipeline" else "cellweave.llm")

    monkeypatch.setattr(importlib, "import_module", missing)
    assert entry._text_queries() == ({}, {})


def test_shuffles_of_stored_tables_are_deleted(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    made = stored(spark.range(10_000).repartition(4, "id"), "some")
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and made.count() == 10_000
