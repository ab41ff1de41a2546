"""Streams run to completion equal the batch operators."""

from pyspark.sql import functions as F

from canlake.operators.deltas import with_delta_id
from canlake.operators.ordering import lay_out
from canlake.streaming.busload import tumbling_load
from canlake.streaming.ingest import ingest_new_captures
from canlake.streaming.lateness import late_frames, on_time, on_time_stream, split_late
from canlake.streaming.interarrival import OUTPUT, InterArrival, late_counts, live_delta_id, rocksdb_state


def text(path, start, count):
    path.write_text("".join(f"Timestamp: {i}.5    ID: 0{i % 3}    000    DLC: 0\n" for i in range(start, start + count)) + "noise\n")


def test_ingest_picks_up_new_files_only_once(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        ingest_new_captures(
            spark, str(raw), "hcrl_carhacking", out, checkpoint, exclude=["skip*"], files_per_batch=1
        ).awaitTermination()
        return spark.read.parquet(out)

    text(raw / "one.txt", 0, 5)
    text(raw / "skip_me.txt", 0, 9)
    assert run().count() == 5
    text(raw / "two.txt", 100, 7)
    table = run()
    assert table.groupBy("session_id").count().orderBy("session_id").collect() == [("one", 5), ("two", 7)]
    assert run().count() == 12
    assert table.select("path", "file_block", "line_key").distinct().count() == 12
    assert table.select("stream").distinct().count() == 1


def test_streams_with_own_checkpoints_share_an_output(spark, tmp_path):
    out = str(tmp_path / "out")
    for name, lines in (("a", 5), ("b", 7)):
        (tmp_path / name).mkdir()
        text(tmp_path / name / f"{name}.txt", 0, lines)
        ingest_new_captures(spark, str(tmp_path / name), "hcrl_carhacking", out, str(tmp_path / f"checkpoint-{name}")).awaitTermination()
    table = spark.read.parquet(out)
    assert table.groupBy("session_id").count().orderBy("session_id").collect() == [("a", 5), ("b", 7)]
    assert table.select("stream").distinct().count() == 2


def run_deltas(spark, deltas, out, checkpoint):
    with rocksdb_state(spark):
        (
            deltas.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
        )


def test_a_hot_key_is_merged_chunk_by_chunk(spark, make_frames, tmp_path):
    """One identifier with fifty chunks in a batch: same deltas, no row lost, nothing left set aside."""
    columns = ["session_id", "Arbitration_ID", "row_id", "Timestamp"]
    schema = "session_id string, Arbitration_ID string, row_id long, Timestamp double"
    rows = [(i, "s", 100 + (i * 7919 % 3000) * 0.25, "100" if i % 10 else "200", 0) for i in range(3000)]
    more = [(i, "s", 900 + i * 0.5, "100", 0) for i in range(3000, 3100)] + [(4000, "s", 100.5, "100", 0), (4001, "s", None, "100", 0)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    before = {key: spark.conf.get(key) for key in ("spark.sql.execution.arrow.maxRecordsPerBatch",)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for batch in (rows, more):
            frames = make_frames([r for r in batch if r[2] is not None]).select(*columns)
            if len(batch) < 200:
                frames = frames.union(spark.createDataFrame([("s", "100", 4001, None)], schema))
            frames.write.mode("append").parquet(str(source))
            stream = spark.readStream.schema(schema).parquet(str(source)).where("row_id >= 0")
            deltas = stream.groupBy("session_id", "Arbitration_ID").transformWithStateInPandas(InterArrival(block_rows=20), OUTPUT, "append", "none") if len(batch) > 200 else live_delta_id(stream)
            run_deltas(spark, deltas, out, tmp_path / "checkpoint")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    got = spark.read.schema(OUTPUT).parquet(out)
    good = [r for r in rows + more if r[2] is not None and r[0] != 4000]
    want = {r["row_id"]: r["Delta_Id"] for r in with_delta_id(lay_out(make_frames(good)).frames).collect()}
    assert {r["row_id"]: r["Delta_Id"] for r in got.where("NOT late").collect()} == want
    assert [r["row_id"] for r in got.where("late AND Delta_Id IS NULL").collect()] == [4000]
    assert got.count() == len(rows) + len(more) - 1
    with rocksdb_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "aside").load(str(tmp_path / "checkpoint"))
        assert state.count() == 0


def test_live_deltas_over_batches(spark, make_frames, tmp_path):
    rows = [(i, "s", 100 + i * 0.25, ["100", "200", "300"][i % 3], 0) for i in range(60)]
    rows.append((60, "s", 1100.0, "100", 0))  # silent for a quarter of an hour
    late = [(90, "s", 101.0, "100", 0)]
    columns = ["session_id", "Arbitration_ID", "row_id", "Timestamp"]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for batch in (rows[:20], rows[20:45], rows[45:] + late):
        make_frames(batch).select(*columns).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("session_id string, Arbitration_ID string, row_id long, Timestamp double").parquet(str(source))
        run_deltas(spark, live_delta_id(stream), out, tmp_path / "checkpoint")
    got = spark.read.schema(OUTPUT).parquet(out)
    want = {r["row_id"]: r["Delta_Id"] for r in with_delta_id(lay_out(make_frames(rows)).frames).collect()}
    assert {r["row_id"]: r["Delta_Id"] for r in got.where("NOT late").collect()} == want
    assert late_counts(got).collect() == [("s", 1)]
    assert got.count() == len(rows) + len(late)


def test_tumbling_load_stream_equals_batch(spark, make_frames, tmp_path):
    frames = make_frames([(i, "s", i * 0.007, f"{i % 4:03X}", 0) for i in range(40)])
    frames.select("session_id", "Arbitration_ID", "Timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, Arbitration_ID string, Timestamp double").parquet(str(tmp_path / "in"))
    (
        tumbling_load(stream).writeStream.outputMode("complete").format("memory").queryName("live_load").trigger(availableNow=True).start().awaitTermination()
    )
    want = {tuple(r) for r in tumbling_load(frames).collect()}
    assert {tuple(r) for r in spark.table("live_load").collect()} == want
    assert sum(r[2] for r in want) == 40


COLUMNS = ["session_id", "Arbitration_ID", "row_id", "Timestamp"]
SCHEMA = "session_id string, Arbitration_ID string, row_id long, Timestamp double"


def test_frames_and_late_frames_are_the_input(spark, make_frames, tmp_path):
    """Append mode over three batches and a last one that closes all windows; three frames come too late, one has no time."""
    batches = [
        [(i, "s", 10 + i * 0.1, f"{i % 3:03X}", 0) for i in range(40)],
        [(i, "t", 15 + (i - 40) * 0.1, f"{i % 3:03X}", 0) for i in range(40, 80)] + [(80, "s", 13.5, "001", 0)],  # 0.4 s old: in time
        [(i, "s", 20 + (i - 81) * 0.1, "001", 0) for i in range(81, 100)] + [(100, "s", 10.05, "000", 0), (101, "t", 15.0, "000", 0), (102, "u", 17.8, "000", 0)],
        [(103, "end", 100.0, "000", 0)],
    ]
    source, out, loads = str(tmp_path / "in"), str(tmp_path / "split"), str(tmp_path / "loads")
    for batch in batches:
        frames = make_frames(batch).select(*COLUMNS)
        if batch[0][0] == 40:
            frames = frames.union(spark.createDataFrame([("t", "100", 200, None)], SCHEMA))
        frames.write.mode("append").parquet(source)
        split_late(spark.readStream.schema(SCHEMA).parquet(source), out, str(tmp_path / "c1")).awaitTermination()
        like = frames.withColumn("event_time", F.lit(None).cast("timestamp"))
        stream = tumbling_load(on_time_stream(spark, out, like), "1 second", "1 second").writeStream.outputMode("append").format("parquet")
        stream.option("path", loads).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    late = sorted(r["row_id"] for r in late_frames(spark, out, like).collect())
    assert late == [100, 101, 102, 200]
    good = on_time(spark, f"{out}/frames", like)
    assert good.count() + len(late) == sum(map(len, batches)) + 1
    windows = spark.read.parquet(loads)
    want = {tuple(r) for r in tumbling_load(good.where("session_id <> 'end'"), "1 second").collect()}
    assert {tuple(r) for r in windows.collect()} == want  # none was dropped behind the watermark
    assert sum(r[2] for r in want) + len(late) + 1 == sum(map(len, batches)) + 1


def test_a_repeated_batch_adds_nothing(spark, make_frames, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "split")
    make_frames([(i, "s", i * 1.0, "000", 0) for i in range(9)]).select(*COLUMNS).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    split_late(stream(), out, str(tmp_path / "c1")).awaitTermination()
    split_late(stream(), out, str(tmp_path / "c2")).awaitTermination()  # a lost checkpoint: batch 0 again
    like = spark.createDataFrame([], SCHEMA + ", event_time timestamp")
    assert on_time(spark, f"{out}/frames", like).count() == 9
