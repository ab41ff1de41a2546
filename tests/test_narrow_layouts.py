"""Queries on times alone lay out times alone."""

import pytest

import __spark_entry__ as entry_module
from canlake.plans import standin as st

ON_TIMES = ["w06_bus_load_session_max", "w05_bus_load_fixed_scale", "w01_deltatime", "w03_relative_time", "w07_time_progress",
            "w13_first_rows_with_delta", "t01_canonical_order"]


@pytest.mark.parametrize("name", ON_TIMES)
def test_only_times_are_rendered_and_moved(spark, sf_dir, monkeypatch, name):
    made, lay_out = [], st.lay_out
    monkeypatch.setattr(st, "_layouts", {})
    monkeypatch.setattr(st, "lay_out", lambda df: made.append(df.columns) or lay_out(df))
    narrow = entry_module.queries()[name](spark, sf_dir)
    assert made == [list(st.TIMES)]
    monkeypatch.setattr(st, "_layouts", {})
    st.layout(spark, sf_dir)
    whole = entry_module.queries()[name](spark, sf_dir)
    assert len(made) == 2  # what is on disk already is not laid out again
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, whole.collect()))
