"""Every registered query beside its SQL on the smallest tables; those without SQL must give rows of a stable schema."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, oracle

SF = "/root/testdata/sf0.001"


def _names():
    from quakeloom import plans

    return sorted(plans.collect()[0])


@pytest.mark.parametrize("name", _names())
def test_query(spark, name):
    got = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert difference(got.toPandas(), oracle(sql, SF)) == ""
    else:
        assert got.count() > 0 and got.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_population_gate_reads_whole_documents(spark, monkeypatch):
    from quakeloom.plans import catalogue_queries

    seen, walk = [], catalogue_queries.crosswalk.exact_id_crosswalk
    monkeypatch.setattr(catalogue_queries.crosswalk, "exact_id_crosswalk", lambda docs, *a: seen.append(docs.count()) or walk(docs, *a))
    d = "/root/testdata/sf0.001"
    catalogue_queries.population_gate(spark, d)
    assert seen == [spark.read.parquet(f"{d}/documents.parquet").count()]
