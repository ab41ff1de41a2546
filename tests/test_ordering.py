"""Positions, halos and ordinals against plain windows, also with one dominant session."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from canlake.operators import deltas, ordering, rolling


@pytest.fixture(scope="module")
def skewed(spark, make_frames):
    """One session with most rows, time ties, and file order that differs from time order."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        session = "big" if rng.random() < 0.8 else rng.choice(["a", "b", "c"])
        rows.append((i, session, round(rng.random() * 40, 1), rng.choice(["100", "200", "7FF"]), rng.choice([0, 0, 0, 1, 2])))
    return make_frames(rows)


@pytest.fixture(scope="module")
def layout(skewed):
    return ordering.lay_out(skewed)


def as_dict(df, key, value):
    return {r[0]: r[1] for r in df.select(key, value).collect()}


def test_positions_follow_time_then_row(skewed, layout):
    plain = W.partitionBy("session_id").orderBy("Timestamp", "row_id")
    want = as_dict(skewed.withColumn("p", F.row_number().over(plain) - 1), "row_id", "p")
    assert as_dict(layout.frames, "row_id", "pos") == want


def test_positions_over_many_partitions(spark, skewed):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordering.lay_out(skewed)
        assert parts.frames.where("session_id = 'big'").select("part").distinct().count() > 1
        plain = W.partitionBy("session_id").orderBy("Timestamp", "row_id")
        want = as_dict(skewed.withColumn("p", F.row_number().over(plain) - 1), "row_id", "p")
        assert as_dict(parts.frames, "row_id", "pos") == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_null_sessions_keep_their_rows(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, "a", 2.0), (2, None, 3.0)], "row_id long, session_id string, Timestamp double")
    assert as_dict(ordering.lay_out(df).frames, "row_id", "pos") == {0: 0, 1: 0, 2: 1}


def test_sessions_table(layout, skewed):
    want = {
        r["session_id"]: (r["n"], r["a"], r["b"])
        for r in skewed.groupBy("session_id").agg(F.count("*").alias("n"), F.min("Timestamp").alias("a"), F.max("Timestamp").alias("b")).collect()
    }
    got = {r["session_id"]: (r["n_frames"], r["t_first"], r["t_last"]) for r in layout.sessions.collect()}
    assert got == want


@pytest.mark.parametrize("block_rows", [1, 7, 1 << 18])
def test_deltas_in_blocks(layout, block_rows):
    s = W.partitionBy("session_id").orderBy("pos")
    i = W.partitionBy("session_id", "Arbitration_ID").orderBy("pos")
    plain = layout.frames.withColumn("d", F.coalesce(F.col("Timestamp") - F.lag("Timestamp").over(s), F.lit(0.0))).withColumn(
        "e", F.coalesce(F.col("Timestamp") - F.lag("Timestamp").over(i), F.lit(0.0))
    )
    assert as_dict(deltas.with_deltatime(layout.frames, block_rows), "row_id", "Deltatime") == as_dict(plain, "row_id", "d")
    assert as_dict(deltas.with_delta_id(layout.frames, block_rows), "row_id", "Delta_Id") == as_dict(plain, "row_id", "e")


def test_deltas_keep_the_other_columns(layout):
    out = deltas.with_delta_id(deltas.with_deltatime(layout.frames, 5), 5)
    assert out.where("DLC IS NULL OR Data_7 IS NULL OR Class IS NULL").count() == 0
    assert out.count() == layout.frames.count()


@pytest.mark.parametrize("block_rows", [10, 23, 1 << 18])
def test_rolling_in_blocks(layout, block_rows):
    width = 10
    s = W.partitionBy("session_id").orderBy("pos")
    i = W.partitionBy("session_id", "Arbitration_ID").orderBy("pos").rangeBetween(-(width - 1), 0)
    plain = layout.frames.withColumn("b", F.lag("Timestamp", width).over(s)).withColumn("f", F.count("*").over(i) / float(width))
    got = rolling.with_rolling(layout.frames, width, block_rows)
    assert as_dict(got, "row_id", "t_back") == as_dict(plain, "row_id", "b")
    assert as_dict(got, "row_id", "freq_id") == as_dict(plain, "row_id", "f")


def test_halo_must_fit_the_block(layout):
    with pytest.raises(ValueError, match="does not fit"):
        ordering.with_halo(layout.frames, before=8, block_rows=4)


@pytest.mark.parametrize("block_rows", [1, 16, 1 << 18])
def test_ordinals_in_blocks(skewed, block_rows):
    plain = W.partitionBy("Class").orderBy("row_id")
    want = as_dict(skewed.withColumn("o", F.row_number().over(plain) - 1), "row_id", "o")
    got = ordering.with_ordinal(skewed, ["Class"], "row_id", block_rows=block_rows)
    assert as_dict(got, "row_id", "ordinal") == want
    sizes = {r["Class"]: r["count"] for r in skewed.groupBy("Class").count().collect()}
    assert {(r["Class"], r["ordinal_total"]) for r in got.select("Class", "ordinal_total").distinct().collect()} == set(sizes.items())


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from canlake import storage

    class Context:
        master = "yarn"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch_root(Session())


def test_first_delta_is_zero_and_checked(layout):
    prepared = deltas.with_deltatime(layout.frames)
    assert deltas.nonzero_first_deltas(prepared).count() == 0
    broken = prepared.withColumn("Deltatime", F.lit(1.0))
    assert deltas.nonzero_first_deltas(broken).count() == 4


def test_large_bookkeeping_is_joined_not_broadcast(spark, layout):
    large = ordering.Layout(spark, layout.path, ordering.BROADCAST_RUNS + 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = large.frames._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert as_dict(large.frames, "row_id", "pos") == as_dict(layout.frames, "row_id", "pos")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block_rows", [4, 7, 64])
def test_temporal_features_from_one_exchange(make_frames, block_rows):
    """Carries serve deltas and are counted nowhere, also where one lies within the halo."""
    rows = [(i, "s" if i % 4 else "t", 10 + i * 0.5 + (i % 3) * 0.01, ["100", "200", "300", "400"][i * i % 4], 0) for i in range(60)]
    laid = ordering.lay_out(make_frames(rows)).frames
    width = 4
    got = {r["row_id"]: (r["Delta_Id"], r["freq_id"], r["t_back"]) for r in rolling.with_temporal(laid, width, block_rows).collect()}
    gaps = {r["row_id"]: r["Delta_Id"] for r in deltas.with_delta_id(laid, block_rows).collect()}
    rolled = {r["row_id"]: (r["freq_id"], r["t_back"]) for r in rolling.with_rolling(laid, width, block_rows).collect()}
    assert got == {i: (gaps[i], *rolled[i]) for i in range(60)}
