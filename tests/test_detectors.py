"""The detectors learn: checked on test rows they never saw."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from canlake.operators import mlp
from canlake.plans.catalog import models

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    if not Path(LARGER).exists():
        pytest.skip("driver tables are not here")
    return LARGER


def test_frame_detector_learns_in_stages(spark, tables):
    report = {r["name"]: r for r in entry_module.queries()["m03_detector_report"](spark, tables).collect()}
    assert report["macro avg"]["f1"] > 0.9
    counts = entry_module.queries()["m01_frame_detector"](spark, tables).collect()
    test = [r for r in counts if r["split"] == "test"]
    assert sum(r["n"] for r in test if r["y_true"] == r["y_pred"]) > 0.95 * sum(r["n"] for r in test)
    found = models.stored_detector(spark, tables).val_f1
    assert len(found) == len(models.ROUNDS) and max(found) > found[0] + 0.1  # later stages go on where earlier ones ended


def test_window_detector_beats_the_majority(spark, tables):
    test = [r for r in entry_module.queries()["m02_window_detector"](spark, tables).collect() if r["split"] == "test"]
    by_class = {}
    for r in test:
        by_class[r["y_true"]] = by_class.get(r["y_true"], 0) + r["n"]
    right, rows = sum(r["n"] for r in test if r["y_true"] == r["y_pred"]), sum(by_class.values())
    assert right / rows > max(by_class.values()) / rows + 0.15


def test_detector_round_trip(spark, tables, tmp_path):
    detector = models.stored_detector(spark, tables)
    detector.save(str(tmp_path / "d"))
    again = mlp.Detector.load(str(tmp_path / "d"))
    assert again.stats == detector.stats and again.val_f1 == detector.val_f1
    assert again.model.weights.toArray().tolist() == detector.model.weights.toArray().tolist()
