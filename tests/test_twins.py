"""Every registered query against its SQL twin on the small tables."""

import pytest
from twin_check import compare, database

import __spark_entry__ as entry_module
from canlake.plans.catalog import QUERIES, TWINS


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_twin(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, TWINS[name]) is None


def test_only_the_detectors_have_no_twin():
    assert {n.split("_")[0] for n in set(QUERIES) - set(TWINS)} == {"m01", "m02", "m03"}
    assert set(TWINS) <= set(QUERIES)


def test_entry_runs(spark, sf_dir):
    assert entry_module.entry(spark).columns == ["label", "rows", "percentage"]
