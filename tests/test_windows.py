"""Windows against brute force, and the 40-frame fixture."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canlake.operators import audits, normalise, windows as win
from canlake.operators.ordering import lay_out
from canlake.schemas import label_schema

FIVE = label_schema("five_class")


@pytest.fixture(scope="module")
def sessions(spark, make_frames):
    rng = random.Random(3)
    rows, row_id = [], 0
    for name, length in (("a", 61), ("b", 5), ("c", 17), ("d", 1)):
        for i in range(length):
            rows.append((row_id, name, i * 0.5, rng.choice(["001", "7FF"]), rng.choice([0, 0, 0, 1, 3])))
            row_id += 1
    return rows, lay_out(make_frames(rows))


def brute(rows, size, stride, last):
    by_session = {}
    for row_id, session, *_, label in rows:
        by_session.setdefault(session, []).append((row_id, label))
    out = set()
    for session, frames in by_session.items():
        for start in range(0, len(frames) - size + 1, stride):
            labels = [label for _, label in frames[start : start + size]]
            attacks = [x for x in labels if x != 0]
            label = labels[-1] if last else (attacks[0] if attacks else labels[0])
            out.add((session, frames[start][0], start, label))
    return out


SHAPES = [(16, 8), (5, 5), (5, 3), (7, 2), (3, 5), (1, 1), (17, 4), (70, 1)]


@pytest.mark.parametrize("size,stride", SHAPES)
def test_first_attack_windows(sessions, size, stride):
    rows, layout = sessions
    got = win.candidate_windows(layout.frames, size, stride, FIVE).select("session_id", "start_row_id", "start_pos", "label")
    assert {tuple(r) for r in got.collect()} == brute(rows, size, stride, last=False)


@pytest.mark.parametrize("size,stride", SHAPES)
def test_last_frame_windows(sessions, size, stride):
    rows, layout = sessions
    got = win.last_frame_windows(layout.frames, size, stride).select("session_id", "start_row_id", "start_pos", "label")
    assert {tuple(r) for r in got.collect()} == brute(rows, size, stride, last=True)


@pytest.mark.parametrize("size,stride", [(16, 8), (5, 3), (3, 5)])
def test_window_norm_stats_count_frames_per_window(sessions, size, stride):
    rows, layout = sessions
    frames = {r["row_id"]: r for r in layout.frames.withColumn("v", F.col("pos").cast("int") % 256).collect()}
    shown = layout.frames.withColumn("DLC", (F.col("pos") % 9).cast("int"))
    values = []
    by_session = {}
    for row_id, session, *_ in rows:
        by_session.setdefault(session, []).append(frames[row_id]["pos"] % 9)
    for dlcs in by_session.values():
        for start in range(0, len(dlcs) - size + 1, stride):
            values += dlcs[start : start + size]
    got = {r["column"]: r for r in normalise.window_stats(shown, layout.sessions, size, stride).collect()}
    assert got["DLC"]["mean"] == pytest.approx(np.mean(values))
    assert got["DLC"]["std"] == pytest.approx(np.std(values))
    assert got["Data_0"]["std"] == 1.0  # constant column


def test_forty_frames(spark, make_frames):
    times = np.linspace(0, 1, 40)
    rows = [(i, "s", t, "123" if i % 2 == 0 else "456", 1 if i >= 30 else 0) for i, t in enumerate(times)]
    frames = lay_out(make_frames(rows)).frames
    index = win.window_references(
        win.candidate_windows(frames, 20, 15, FIVE), 20
    )
    labels = lambda df: [r["label"] for r in df.orderBy("start_row_id").collect()]
    assert [r["start_row_id"] for r in index.orderBy("start_row_id").collect()] == [0, 15]
    assert labels(win.relabel(index, frames, "any_attack")) == [0, 1]
    assert labels(win.relabel(index, frames, "last_frame")) == [0, 1]
    with pytest.raises(ValueError, match="label rule"):
        win.relabel(index, frames, "first_frame")


def test_materialised_windows_are_consecutive(sessions):
    rows, layout = sessions
    index = win.window_references(win.candidate_windows(layout.frames, 5, 3, FIVE), 5)
    found = win.collect_windows(
        win.expand_references(index, layout.frames, ["row_id"]), ["window_id", "start_row_id"], 5, {"rows": F.col("row_id")}
    ).collect()
    assert len(found) == index.count()
    assert all(list(r["rows"]) == list(range(r["start_row_id"], r["start_row_id"] + 5)) for r in found)


def test_references_that_do_not_fit(spark, sessions):
    _, layout = sessions
    index = spark.createDataFrame(
        [("a:0", "a", 0, 5, 0), ("a:58", "a", 58, 5, 0), ("a:999", "a", 999, 5, 0), ("zz:0", "zz", 0, 5, 0)],
        "window_id string, session_id string, start_row_id long, window_size long, label long",
    )
    bad = {r["window_id"]: r["found"] for r in win.incomplete_windows(index, layout.frames).collect()}
    assert bad == {"a:58": 3, "a:999": 0, "zz:0": 0}
    assert [r[0] for r in win.unknown_sessions(index, layout.frames).collect()] == ["zz"]


def test_homogeneity_fails_fast(sessions):
    _, layout = sessions
    index = win.window_references(win.candidate_windows(layout.frames, 16, 8, FIVE), 16)
    with pytest.raises(ValueError, match="several attack labels"):
        audits.require_homogeneous(layout.frames, index, FIVE)
    calm = layout.frames.withColumn("Class", F.when(F.col("Class") > 0, 1).otherwise(0))
    audits.require_homogeneous(calm, index, FIVE)


def test_masked_sequence(spark, make_frames):
    rows = [(i, "s", i, f"{i:03X}", 0 if i < 3 else 2, 2, ["0A", "FF"] + ["PAD"] * 6) for i in range(4)]
    row = win.masked_sequences(lay_out(make_frames(rows)).frames, 4, 4, FIVE).first()
    assert list(row["temporal"]) == [256, 257, 258, 2305]
    assert list(row["spatial"]) == [10, 255] + [2304] * 6
    assert (row["target"], row["attack"], row["start_row_id"]) == (259, 1, 0)


def test_expanded_window_audits(spark):
    table = spark.createDataFrame(
        [("w1", [0, 5, 1]), ("w2", [1, 2, 0]), ("w3", [0, 0])], "window_id string, frame_labels array<int>"
    )
    ten = label_schema("ten_state_attack")
    assert tuple(audits.mixed_windows(table, ten).first()) == (1, 1)
    assert {tuple(r) for r in audits.window_lengths(table).collect()} == {(3, 2), (2, 1)}


@pytest.mark.parametrize("size,stride", [(5, 3), (16, 8), (3, 5), (1, 1), (7, 2)])
@pytest.mark.parametrize("block_rows", [1, 6, 20, 1 << 18])
def test_window_contents_in_blocks(sessions, size, stride, block_rows):
    rows, layout = sessions
    row = F.col("row_id")
    gathered = win.gather_windows(layout.frames, size, stride, {"rows": row}, {"first": (0, row), "end": (size - 1, row)}, block_rows)
    got = {(r["session_id"], tuple(r["rows"]), r["first"], r["end"]) for r in gathered.collect()}
    want = {
        (session, tuple(range(first, first + size)), first, first + size - 1)
        for session, first, *_ in brute(rows, size, stride, False)
    }
    assert got == want


def test_window_contents_need_one_shuffle(sessions):
    _, layout = sessions
    gathered = win.gather_windows(layout.frames, 16, 8, {"rows": F.col("row_id")})
    plan = gathered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("reach", [(0, 4), (-4, 0), (-2, 3), (1, 2), (-3, -1), (0, 0)])
def test_counts_beside_equal_plain_counts(spark, reach):
    rng = random.Random(6)
    marks = [(s, p, int(rng.random() < 0.5), int(rng.random() < 0.2)) for s in ("a", "b") for p in range(90) if rng.random() < 0.4]
    asks = [(s, p, i) for i, (s, p) in enumerate((rng.choice("abc"), rng.randrange(95)) for _ in range(200))]
    got = win.counts_beside(
        spark.createDataFrame(marks, "session_id string, pos long, x int, y int"), spark.createDataFrame(asks, "session_id string, pos long, n long"), ["x", "y"], reach, block_rows=7
    )
    want = {n: tuple(sum(m[k] for m in marks if m[0] == s and p + reach[0] <= m[1] <= p + reach[1]) for k in (2, 3)) for s, p, n in asks}
    assert {r["n"]: (r["x"], r["y"]) for r in got.collect()} == want


def test_windows_of_several_sizes_are_audited_each(spark, make_frames):
    laid = lay_out(make_frames([(i, "s", i, "100", [0, 1, 0, 2, 0, 0, 3, 0][i]) for i in range(8)])).frames
    index = spark.createDataFrame([("s:0", "s", 0, 4, 1), ("s:1", "s", 1, 2, 1), ("s:3", "s", 3, 4, 2), ("s:9", "s", 9, 2, 0)], "window_id string, session_id string, start_row_id long, window_size long, label long")
    found = audits.heterogeneous_windows(laid, index, label_schema("five_class")).collect()
    assert {r["window_id"]: r["attack_labels"] for r in found} == {"s:0": [1, 2], "s:3": [2, 3]}
    short = {r["window_id"]: r["found"] for r in win.incomplete_windows(index, laid).collect()}
    assert short == {"s:9": 0}


def test_materialised_windows_hold_their_frames(make_frames):
    laid = lay_out(make_frames([(i, "s", i, f"{i:03X}", 0) for i in range(20)] + [(100 + i, "t", i, "001", 0) for i in range(3)])).frames
    index = win.window_references(win.candidate_windows(laid, 6, 2, label_schema("five_class")), 6).where("start_row_id <> 4")
    rows = {r["start_row_id"]: r["rows"] for r in win.materialise(index, laid, 6, 2, {"rows": F.col("row_id")}).collect()}
    assert rows == {i: list(range(i, i + 6)) for i in range(0, 15, 2) if i != 4}
