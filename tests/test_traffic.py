"""Byte patterns, segments and swarm layout by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canlake.operators import traffic
from canlake.operators.ordering import lay_out
from canlake.schemas import label_schema


def byte_rows(can_id, values, first_row, session="s", dlc=2):
    return [
        (first_row + i, session, float(first_row + i), can_id, 0, dlc, ["PAD" if v is None else f"{v:02X}"] + ["07"] + ["PAD"] * 6)
        for i, v in enumerate(values)
    ]


def test_each_byte_pattern(make_frames):
    rng = np.random.default_rng(0)
    series = {
        "001": [5] * 40,  # constant
        "002": [i % 20 for i in range(40)],  # rises 19 times out of 20
        "003": [int(v) for v in rng.integers(0, 4, 40)],  # few values
        "004": [int(v) for v in rng.integers(0, 256, 40)],  # many values, no direction
        "005": [None] * 40,  # never sent
        "006": [9],  # a single frame
        "007": [None, 1, None, 2, None, 3] + [i % 30 for i in range(4, 34)],  # gaps do not break the series
    }
    rows, next_row = [], 0
    for can_id, values in series.items():
        rows += byte_rows(can_id, values, next_row)
        next_row += len(values)
    found = {(r["Arbitration_ID"], r["byte"]): r["pattern"] for r in traffic.byte_patterns(lay_out(make_frames(rows)).frames).collect()}
    first = {k[0]: v for k, v in found.items() if k[1] == 0}
    assert first == {
        "001": "Constant", "002": "Sawtooth", "003": "Random", "004": "Polynomial", "005": "No byte", "006": "Constant", "007": "Sawtooth",
    }
    assert {v for k, v in found.items() if k[1] == 1} == {"Constant"}
    assert {v for k, v in found.items() if k[1] >= 2} == {"No byte"}


def test_byte_patterns_across_partitions(spark, make_frames):
    rng = np.random.default_rng(1)
    rows = byte_rows("0AA", [i % 64 for i in range(300)], 0) + byte_rows("0BB", [int(v) for v in rng.integers(0, 200, 300)], 300, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = lay_out(make_frames(rows))
        assert laid.frames.select("part").distinct().count() > 2
        got = traffic.byte_patterns(laid.frames).where("byte = 0")
        assert {r["Arbitration_ID"]: r["pattern"] for r in got.collect()} == {"0AA": "Sawtooth", "0BB": "Polynomial"}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_segments(make_frames):
    labels = [0, 0, 1, 1, 1, 0, 2]
    layout = lay_out(make_frames([(i, "s", 100 + i * 0.5, "100", label) for i, label in enumerate(labels)]))
    got = {
        (r["Class"], r["first_pos"]): (r["frames"], r["start_ms"], r["end_ms"])
        for r in traffic.attack_segments(layout.frames, layout.sessions).collect()
    }
    assert got == {
        (0, 0): (2, 0.0, 500.0), (1, 2): (3, 1000.0, 2000.0), (0, 5): (1, 2500.0, 2500.01), (2, 6): (1, 3000.0, 3000.01),
    }


def test_swarm_is_centred_and_clipped(spark):
    df = spark.createDataFrame([(i, "g", 1.0) for i in range(5)] + [(9, "g", 50.0)] + [(20, "one", 3.0)], "row_id long, g string, v double")
    got = {r["row_id"]: r["offset"] for r in traffic.swarm_offsets(df, ["g"], "v", "row_id").collect()}
    assert [got[i] for i in range(5)] == pytest.approx([-0.11, -0.055, 0, 0.055, 0.11])
    assert got[9] == 0.0 and got[20] == 0.0
    many = spark.range(1001).select(F.col("id").alias("row_id"), F.lit("g").alias("g"), F.lit(1.0).alias("v"))
    offsets = [r["offset"] for r in traffic.swarm_offsets(many, ["g"], "v", "row_id").collect()]
    assert min(offsets) == pytest.approx(-0.42) and max(offsets) == pytest.approx(0.42)


def test_attack_only_ids_in_numeric_order(make_frames):
    frames = make_frames([(0, "s", 0, "7FF", 1), (1, "s", 1, "0A0", 2), (2, "s", 2, "100", 0), (3, "s", 3, "100", 1)])
    got = [r["Arbitration_ID"] for r in traffic.attack_only_ids(frames, label_schema("five_class")).collect()]
    assert got == ["0A0", "7FF"]


def test_present_classes_contiguity(make_frames):
    gap = make_frames([(0, "s", 0, "100", 0), (1, "s", 1, "100", 2)])
    assert tuple(traffic.present_classes(gap).first()) == ([0, 2], False)
