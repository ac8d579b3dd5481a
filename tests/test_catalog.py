import os

import pytest
from compare import assert_same, connect

from dupscan.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_twin(spark, data, con, name):
    assert_same(catalog.QUERIES[name](spark, data), catalog.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_twin_has_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_is_pruned(spark, data):
    plan = catalog.QUERIES["window_candidates"](spark, data)._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("n_chars" not in line.split("ReadSchema")[1] for line in scans)


@pytest.mark.parametrize("name", ["jaccard_pairs", "similar_documents", "levenshtein_pairs"])
def test_shuffles_stay_near_the_input(spark, data, name):
    """Not all windows go through shuffles; at sf0.001 that took 17.6 times the size of the documents."""
    written = lambda: sum(x.totalShuffleWrite() for x in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(True))))
    before = written()
    catalog.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < written() - before < 6 * os.path.getsize(f"{data}/documents.parquet")
