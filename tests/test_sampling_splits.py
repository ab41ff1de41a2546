"""Permutations, samples and splits."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canlake.operators import audits, sampling as smp, splits
from canlake.operators.ordering import lay_out
from canlake.schemas import label_schema


@pytest.mark.parametrize("size", [0, 1, 2, 3, 10, 97, 1000, 1024, 1_000_003, 97_003 * 2])
@pytest.mark.parametrize("label,stream", [(0, 0), (4, 1), (9, 2)])
def test_permutation_is_a_bijection(size, label, stream):
    rounds = smp.permutation_of(size, 42, label, stream)
    assert len(rounds) == (0 if size < 2 else smp.ROUNDS)
    for r in rounds:
        assert math.gcd(r.multiplier, size) == 1 and 0 <= r.shift < size and r.odd % 2 == 1 and 0 <= r.turn < r.fold <= size < 2 * r.fold
    if size < 2000:
        assert sorted(smp.permuted_number(i, size, rounds) for i in range(size)) == list(range(size))


@pytest.mark.parametrize("size", [2000, 10**10, 10**13, 10**18])
def test_permutation_is_exact_and_spread_at_scale(spark, size):
    seed = 2**31
    rounds = smp.permutation_of(size, seed, 9, 1)
    rows = spark.range(size - 200, size).selectExpr("id", "9 AS label")
    ranks = [r["rank"] for r in smp.with_permuted(rows, "rank", "id", "label", {9: size}, seed, 1).orderBy("id").collect()]
    assert ranks == [smp.permuted_number(i, size, rounds) for i in range(size - 200, size)]
    in_train, longest = 0, 0
    for r in ranks:
        in_train = in_train + 1 if r < size * 0.6 else 0
        longest = max(longest, in_train)
    assert longest <= 25 and 80 <= sum(r < size * 0.6 for r in ranks) <= 160


@pytest.mark.parametrize("size", [5000, 65_536, 99_991])
def test_seeds_streams_and_labels_draw_unrelated_test_sets(size):
    """Two test sets of a fifth share about a fifth of their rows, not all or none as rotations may."""
    tests = []
    for seed, label, stream in ((1, 0, 2), (2, 0, 2), (3, 0, 2), (42, 0, 2), (42, 1, 2), (42, 0, 1), (43, 0, 2)):
        rounds = smp.permutation_of(size, seed, label, stream)
        tests.append({i for i in range(size) if smp.permuted_number(i, size, rounds) >= size * 0.8})
    for i, a in enumerate(tests):
        assert abs(len(a) - size * 0.2) < 2
        for b in tests[:i]:
            assert 0.15 < len(a & b) / len(a) < 0.25


@pytest.mark.parametrize(
    "sizes,wanted,want",
    [
        ({0: 50, 1: 30, 2: 20}, 10, {0: 5, 1: 3, 2: 2}),
        ({0: 1, 1: 1, 2: 1}, 2, {0: 1, 1: 1, 2: 0}),  # equal fractions: lower class first
        ({0: 7, 1: 3}, 5, {0: 4, 1: 1}),  # 3.5 and 1.5: tie, class 0 gets the spare
        ({0: 7, 1: 3}, 50, {0: 7, 1: 3}),
        ({0: 7, 1: 3}, None, {0: 7, 1: 3}),
    ],
)
def test_apportion(sizes, wanted, want):
    assert smp.apportion(sizes, wanted) == want


@pytest.mark.parametrize("total,points", [(1, 5), (5, 5), (6, 5), (100, 7), (1234, 150), (10_001, 1500), (99, 98)])
def test_evenly_spaced_like_linspace(spark, total, points):
    got = spark.range(total).where(smp.evenly_spaced(F.col("id"), F.lit(total), points)).collect()
    want = range(total) if total <= points else sorted(set(np.linspace(0, total - 1, points).astype(int)))
    assert sorted(r[0] for r in got) == list(want)


def test_capped_sample_keeps_small_groups_whole(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 10, "small").otherwise("big").alias("g"))
    got = {r["g"]: r["count"] for r in smp.capped_sample(df, ["g"], "row_id", 50).groupBy("g").count().collect()}
    assert got == {"small": 10, "big": 50}


@pytest.mark.parametrize("cap", [1, 7, 100, 2000])
def test_capped_sample_takes_the_smallest_hashes(spark, cap, monkeypatch):
    group = F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    df = spark.range(3000).select(F.col("id").alias("row_id"), group.alias("g"))
    ranked = {}
    for row_id, g in df.collect():
        ranked.setdefault(g, []).append((hashlib.md5(f"42:{row_id}".encode()).hexdigest(), row_id))
    want = {r for rows in ranked.values() for _, r in sorted(rows)[:cap]}
    assert {r["row_id"] for r in smp.capped_sample(df, ["g"], "row_id", cap).collect()} == want
    monkeypatch.setattr(smp, "EARLY_SLICES", 0)  # nothing counted: every group is ranked whole
    assert {r["row_id"] for r in smp.capped_sample(df, ["g"], "row_id", cap).collect()} == want


@pytest.fixture(scope="module")
def frames(make_frames):
    return make_frames([(i, f"cap_{i % 4}", i * 0.1, "100", 0 if i % 10 < 7 else i % 3) for i in range(400)])


def test_balanced_downsample(frames):
    got = smp.downsample_balanced(frames, "Class", "row_id").groupBy("Class").count().collect()
    sizes = {r["Class"]: r["count"] for r in frames.groupBy("Class").count().collect()}
    assert {r["count"] for r in got} == {min(sizes.values())} and len(got) == len(sizes)
    with pytest.raises(ValueError, match="smallest class"):
        smp.downsample_balanced(frames, "Class", "row_id", requested=min(sizes.values()) + 1)


def test_stratified_split_counts(frames):
    table = splits.stratified_frames(frames, 0.2, 0.1)
    for label, size in ((r["Class"], r["count"]) for r in frames.groupBy("Class").count().collect()):
        got = {r["split"]: r["count"] for r in table.where(F.col("Class") == label).groupBy("split").count().collect()}
        n_val, n_test = int(size * 0.2), int(size * 0.1)
        assert got == {"train": size - n_val - n_test, "val": n_val, "test": n_test}
    assert table.select("row_id").distinct().count() == frames.count()
    assert {r["lost"] for r in audits.split_accounting(frames, table, "Class").collect()} == {0}


@pytest.mark.parametrize("val,test", [(1.0, 0.0), (-0.1, 0.2), (0.5, 0.5)])
def test_ratios_are_checked(frames, val, test):
    with pytest.raises(ValueError, match="ratio"):
        splits.stratified_frames(frames, val, test)


def test_session_holdout(frames):
    table = splits.holdout_frames(frames, ["cap_1"], ["cap_2"])
    got = {(r["session_id"], r["split"]) for r in table.select("session_id", "split").distinct().collect()}
    assert got == {("cap_0", "train"), ("cap_1", "val"), ("cap_2", "test"), ("cap_3", "train")}
    with pytest.raises(ValueError, match="both"):
        splits.holdout_frames(frames, ["cap_1"], ["cap_1"])
    with pytest.raises(ValueError, match="do not exist"):
        splits.holdout_frames(frames, ["cap_9"], [])
    assert splits.holdout_frames(frames, [], []).where("split <> 'train'").count() == 0


def test_window_split_with_downsampling(frames):
    laid = lay_out(frames).frames
    five = label_schema("five_class")
    table = splits.stratified_windows(laid, 10, 5, five, downsample=True)
    per_label = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    assert len(set(per_label.values())) == 1
    assert splits.stratified_windows(laid, 10, 5, five, downsample_size=2).count() == 2 * len(per_label)
    with pytest.raises(ValueError, match="long enough"):
        splits.stratified_windows(laid, 1000, 5, five)


def test_audits_of_a_leaky_split(spark):
    table = spark.createDataFrame(
        [("w1", "a", 0, "train"), ("w1", "a", 0, "val"), ("w2", "b", 1, "train"), ("w3", "b", 0, "test"), ("w3", "b", 0, "test")],
        "window_id string, session_id string, label int, split string",
    )
    shared = {r["pair"]: r["shared"] for r in audits.identifier_overlap(table, "window_id").collect()}
    assert shared == {"train__val": 1, "train__test": 0, "val__test": 0}
    assert {tuple(r) for r in audits.session_overlap(table).collect()} == {("train__val", "a"), ("train__test", "b")}
    assert {tuple(r) for r in audits.missing_classes(table, "label").select("split", "label").collect()} == {("val", 1), ("test", 1)}
    assert tuple(audits.duplicate_count(table, "window_id").first()) == (5, 3, 2)
    report = {r["split"]: (r["rows"], r["classes"], r["sessions"], r["duplicates"]) for r in audits.split_report(table, "label", "window_id").collect()}
    assert report == {"train": (2, 2, 2, 0), "val": (1, 1, 1, 0), "test": (2, 1, 1, 1)}


def test_leaked_frames_by_hand(spark, make_frames):
    laid = lay_out(make_frames([(i, "s", i, "100", 0) for i in range(8)])).frames
    windows = spark.createDataFrame(
        [("s", 0, "train"), ("s", 2, "val"), ("s", 4, "val")], "session_id string, start_row_id long, split string"
    )
    leaked = {r["row_id"]: list(r["splits"]) for r in audits.leaked_frames(laid, windows, stride=2, size=4).collect()}
    assert leaked == {2: ["train", "val"], 3: ["train", "val"]}
