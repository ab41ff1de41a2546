import __spark_entry__ as entry_module
import pytest
from twin_check import compare, database


def test_all_queries_are_registered():
    names = entry_module.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op7_url_filter", "op11_importance_resampling", "op12_line_runs", "op13_phrase_tiles"])
def test_query_equals_twin(spark, sf_dir, name):
    assert compare(entry_module.queries()[name](spark, sf_dir), database(sf_dir), entry_module.oracle_sql()[name]) is None
