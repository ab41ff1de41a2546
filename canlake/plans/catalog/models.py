"""Detectors trained by Spark ML, and the streaming operators run to completion."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from canlake.functions.encodings import id_value
from canlake.functions.labels import class_id
from canlake.operators import audits, mlp, scoring, splits
from canlake.plans import stages, standin as st
from canlake.plans.catalog.registry import query
from canlake.plans.catalog.sources import ROAD, SURVIVAL_LABEL, capture_of, survival_stem, road_stem, text_captures
from canlake.plans.catalog.twins import FRAMES, PREPARED, permuted, split_case
from canlake.plans.catalog.windows import PERMUTED
from canlake.sources.candump import write_injections
from canlake.storage import scratch_path, settle
from canlake.streaming.ingest import ingest_new_captures
from canlake.streaming.busload import tumbling_load
from canlake.streaming.interarrival import OUTPUT, live_delta_id, rocksdb_state
from canlake.streaming.lateness import late_frames, on_time_stream, split_late

ROUNDS = (25, 25, 25, 25)
_stored: dict[tuple[str, str, int], tuple[str, DataFrame]] = {}


def scored_splits(predictions):
    """Confusion counts of each split, the input of every metric."""
    return predictions.groupBy("split", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def split_frames(spark, sf_dir):
    return splits.stratified_frames(st.labelled(spark, sf_dir))


def stored(spark, sf_dir):
    """Folder of the frame detector and the split frames, made once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, st.table(spark, sf_dir, "events").count())
    if key not in _stored:
        frames = settle(split_frames(spark, sf_dir), "split-frames")
        path = scratch_path(spark, "frame-detector")
        mlp.train_frame_detector(frames, st.FIVE.num_classes, ROUNDS).save(path)
        _stored[key] = path, frames
    return _stored[key]


def stored_detector(spark, sf_dir):
    """The frame detector of these tables: trained and stored once in an application, loaded by every query."""
    return mlp.Detector.load(stored(spark, sf_dir)[0])


def frame_predictions(spark, sf_dir):
    detector, frames = stored_detector(spark, sf_dir), stored(spark, sf_dir)[1]
    return mlp.predictions(detector.model, mlp.frame_inputs(frames, detector.stats))


@query("m01_frame_detector")
def frame_detector(spark, sf_dir):
    return scored_splits(frame_predictions(spark, sf_dir))


@query(
    "m01_scored_rows",
    f"""WITH {PERMUTED} SELECT split, "Class" AS y_true, count(*) AS rows FROM (
          SELECT *, {split_case("rank", "size")} AS split FROM (SELECT *, {permuted("ordinal")} AS rank FROM ordered JOIN perm ON lab = "Class")) GROUP BY ALL""",
)
def scored_rows(spark, sf_dir):
    """Every frame is scored once: rows for each split and true class out of the predictions."""
    return frame_predictions(spark, sf_dir).where("y_pred IS NOT NULL").groupBy("split", "y_true").agg(F.count(F.lit(1)).alias("rows"))


@query("m02_window_detector")
def window_detector(spark, sf_dir):
    layout = st.layout(spark, sf_dir)
    index = settle(splits.stratified_windows(layout.frames, st.WINDOW, st.STRIDE, st.FIVE), "split-windows")
    detector, inputs = mlp.train_window_detector(
        layout.frames, index, layout.sessions, st.WINDOW, st.STRIDE, st.FIVE.num_classes, ROUNDS
    )
    return scored_splits(mlp.predictions(detector.model, inputs))


@query("m03_detector_report")
def detector_report(spark, sf_dir):
    return scoring.classification_report(frame_predictions(spark, sf_dir).where("split = 'test'"), st.FIVE.class_names)


@query(
    "r01_streamed_ingest",
    f"""WITH {FRAMES} SELECT session_id AS capture, round("Timestamp", 6) AS "Timestamp", Arbitration_ID, DLC, Data_3, 'Normal' AS attack_type FROM frames""",
)
def streamed_ingest(spark, sf_dir):
    folder, output = text_captures(spark, sf_dir), scratch_path(spark, "ingested")
    ingest_new_captures(
        spark, folder, "hcrl_carhacking", output, scratch_path(spark, "ingest-checkpoint")
    ).awaitTermination()
    return spark.read.parquet(output).select(
        capture_of(F.col("path")).alias("capture"), F.round("Timestamp", 6).alias("Timestamp"), "Arbitration_ID",
        F.col("DLC").cast("int").alias("DLC"), "Data_3", "attack_type",
    )


@query(
    "r02_live_delta_id",
    f"WITH {PREPARED} SELECT row_id, session_id, round(Delta_Id, 6) AS Delta_Id, false AS late FROM prepared",
)
def live_deltas(spark, sf_dir):
    source, output = scratch_path(spark, "live-frames"), scratch_path(spark, "live-deltas")
    frames = st.frames(spark, sf_dir).select("session_id", "Arbitration_ID", "row_id", "Timestamp")
    frames.write.parquet(source)
    stream = spark.readStream.schema(frames.schema).parquet(source)
    with rocksdb_state(spark):
        (
            live_delta_id(stream)
            .writeStream.format("parquet")
            .option("path", output)
            .option("checkpointLocation", scratch_path(spark, "live-checkpoint"))
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.schema(OUTPUT).parquet(output).select(
        "row_id", "session_id", F.round("Delta_Id", 6).alias("Delta_Id"), "late"
    )


LATENESS, LOAD_WINDOW = "6 hours", "1 hour"


def delivery(row, rows):
    """Which of three deliveries brings a frame: thirds of the log, but every 97th frame of the first comes with the last."""
    third = F.least(F.floor(row * 3 / rows), F.lit(2))
    return F.when((third == 0) & (row % 97 == 5), 2).otherwise(third)


@query(
    "r03_streamed_load",
    f"""WITH {FRAMES}, sized AS (SELECT count(*) AS n FROM frames),
        sent AS (SELECT session_id, Arbitration_ID, CAST(round("Timestamp" * 1e6::DOUBLE) AS BIGINT) AS us, least(row_id * 3 // n, 2) AS third, row_id FROM frames, sized),
        delivered AS (SELECT *, CASE WHEN third = 0 AND row_id % 97 = 5 THEN 2 ELSE third END AS delivery FROM sent),
        reached AS (SELECT delivery, max(us) AS newest FROM delivered GROUP BY delivery),
        judged AS (SELECT d.*, coalesce(us < (SELECT max(newest) FROM reached r WHERE r.delivery < d.delivery) - 21600000000, false) AS late FROM delivered d),
        closed AS (SELECT max(us) // 1000 * 1000 - 21600000000 AS mark FROM judged WHERE NOT late)
        SELECT session_id, us // 3600000000 * 3600000000 AS start_us, count(*) AS frames, CAST(count(DISTINCT Arbitration_ID) AS INTEGER) AS ids
        FROM judged, closed WHERE NOT late AND us // 3600000000 * 3600000000 + 3600000000 <= mark GROUP BY 1, 2
        UNION ALL SELECT session_id, NULL, count(*), NULL FROM judged WHERE late GROUP BY 1""",
)
def streamed_load(spark, sf_dir):
    """Load windows of a stream in append mode, and its late frames (rows without a window)."""
    source, output, loads = (scratch_path(spark, f"load-{name}") for name in ("source", "split", "windows"))
    frames = st.frames(spark, sf_dir).select("session_id", "Arbitration_ID", "row_id", "Timestamp")
    rows = frames.count()
    schema, checkpoints = frames.schema, [scratch_path(spark, "load-checkpoint") for _ in range(2)]
    stored = on_time = None
    for number in range(3):
        frames.where(delivery(F.col("row_id"), F.lit(rows)) == number).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        split_late(arriving, output, checkpoints[0], LATENESS).awaitTermination()
        stored = frames.withColumn("event_time", F.lit(None).cast("timestamp"))
        on_time = on_time_stream(spark, output, stored)
        with rocksdb_state(spark):
            (
                tumbling_load(on_time, LOAD_WINDOW, LATENESS)
                .writeStream.outputMode("append").format("parquet").option("path", loads)
                .option("checkpointLocation", checkpoints[1]).trigger(availableNow=True).start().awaitTermination()
            )
    late = late_frames(spark, output, stored).groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"))
    windows = spark.read.schema("session_id string, start_us long, frames long, ids int").parquet(loads)
    return windows.unionByName(late, allowMissingColumns=True)


#: Dialect, label schema, variant of the captures that go from files to split tables.
CORPORA = (
    ("car_hacking_attack_defense", "binary", None),
    ("road_raw", "road", "fabrication"),
    ("survival_analysis", "SurvivalAnalysis", None),
)


@query(
    "stages_files_to_splits",
    f"""WITH {ROAD},
        labelled AS (
          SELECT 'car_hacking_attack_defense' AS corpus, session_id AS stem, row_id AS line, CASE WHEN attack_type = 'Normal' THEN 0 ELSE 1 END AS "Class" FROM frames
          UNION ALL SELECT 'road_raw', stem, row_id, CASE WHEN hit THEN CAST(list_position(['MEC','Fuzzing','MS','RLOn','RLOff','CS'], family) AS INTEGER) ELSE 0 END
            FROM road_rule WHERE id_number <= 1792 AND raw <> '' AND cap_no % 2 = 0 AND cap_no <> 14 AND cap_no % 7 <> 6
          UNION ALL SELECT 'survival_analysis', {survival_stem()}, row_id, CASE {SURVIVAL_LABEL} WHEN 'Flooding' THEN 1 WHEN 'Fuzzing' THEN 2 WHEN 'Malfunction' THEN 3 ELSE 0 END FROM frames),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY stem, line) - 1 AS id, dense_rank() OVER (PARTITION BY corpus ORDER BY stem) AS place FROM labelled)
        SELECT corpus, CASE place WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'train' END AS outcome, CAST("Class" AS INTEGER) AS "Class", count(*) AS rows, CAST(sum(id) AS BIGINT) AS row_ids
        FROM numbered GROUP BY ALL
        UNION ALL SELECT 'road_raw', CASE WHEN id_number > 1792 THEN 'out_of_scope' ELSE 'bad_payload' END, NULL, count(*), NULL FROM road
        WHERE (id_number > 1792 OR raw = '') AND cap_no % 2 = 0 AND cap_no <> 14 AND cap_no % 7 <> 6 GROUP BY 2""",
)
def files_to_splits(spark, sf_dir):
    """Capture files of three corpora through ingest, prepare and split; rows per split and class, and rejects.

    The first two captures of a corpus by name are its validation and test sessions.
    """
    base = st.rendered(spark, sf_dir)
    with ThreadPoolExecutor(len(CORPORA)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(corpus_to_splits), spark, sf_dir, base, *corpus) for corpus in CORPORA]
    return reduce(DataFrame.unionByName, [one.result() for one in begun])


def corpus_to_splits(spark, sf_dir, base, corpus, schema, variant):
    """One corpus from its files to its splits; corpora share nothing but the frames they are rendered from."""
    folder, canonical, output, sidecar = st.write_captures(spark, sf_dir, corpus, base), *(scratch_path(spark, n) for n in ("canonical", "splits", "sidecar"))
    if corpus == "road_raw":
        write_injections(st.injections(spark, sf_dir, base), sidecar)
    rejects = stages.ingest(spark, folder, corpus, canonical, variant, metadata=sidecar if corpus == "road_raw" else None)
    frames, layout = stages.prepare(spark.read.parquet(canonical), schema, variant, ["deltatime"])
    held = [r[0] for r in layout.sessions.select("session_id").orderBy("session_id").limit(2).collect()]
    stages.split(frames, output, schema, variant, val_sessions=held[:1], test_sessions=held[1:])
    rows = spark.read.parquet(output).groupBy(F.col("split").alias("outcome"), "Class").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("row_ids")
    )
    lost = rejects.groupBy(F.col("reject_reason").alias("outcome")).agg(F.sum("lines").alias("rows"))
    return rows.unionByName(lost, allowMissingColumns=True).select(F.lit(corpus).alias("corpus"), "outcome", "Class", "rows", "row_ids")


@query(
    "s21_contract_of_a_table",
    f"""WITH {FRAMES}, counted AS (SELECT count(*) AS rows, count(*) FILTER (attack_type NOT IN ('Normal', 'Flooding', 'Fuzzing', 'Malfunction')) AS unmapped,
          count(*) FILTER (CAST('0x' || Arbitration_ID AS INTEGER) > 1792) AS scope, count(*) FILTER (DLC < 8) AS short FROM frames)
        SELECT unnest(['missing_columns', 'unmapped_label', 'identifier_out_of_scope', 'no_session', 'short_frame', 'no_time']) AS rule,
               unnest([CAST(2 AS BIGINT), unmapped, scope, 0, short, 0]) AS broken, rows FROM counted""",
)
def contract_of_a_table(spark, sf_dir):
    """Rules of the frames checked while they are written: labels of another corpus, two columns not made yet."""
    contract = audits.Contract(
        {
            "unmapped_label": class_id("SurvivalAnalysis", strict=False).isNull(),
            "identifier_out_of_scope": id_value() > 0x700,
            "no_session": F.col("session_id").isNull(),
            "short_frame": F.col("DLC") < 8,
            "no_time": F.col("Timestamp").isNull(),
        },
        required=("row_id", "session_id", "Deltatime", "Delta_Id"),
    )
    contract.watched(st.frames(spark, sf_dir)).write.parquet(scratch_path(spark, "watched"))
    return contract.report(spark)


@query(
    "p17_contract_of_a_split",
    f"""WITH {PERMUTED}, s AS (SELECT *, {split_case("rank", "size")} AS split FROM (SELECT *, {permuted("ordinal")} AS rank FROM ordered JOIN perm ON lab = "Class")),
        counted AS (SELECT count(*) AS rows, count(*) FILTER (split <> 'train') AS held, count(*) FILTER (split = 'train') AS trained,
          count(*) FILTER ("Class" >= 4) AS beyond FROM s)
        SELECT unnest(['missing_columns', 'class_out_of_range', 'not_in_train', 'not_held_out', 'no_split']) AS rule,
               unnest([CAST(0 AS BIGINT), beyond, held, trained, 0]) AS broken, rows FROM counted""",
)
def contract_of_a_split(spark, sf_dir):
    """Rules of split frames for a detector of four classes: classes in range, shares of the splits."""
    split = F.col("split")
    contract = audits.Contract(
        {
            "class_out_of_range": ~F.col("Class").between(0, 3),
            "not_in_train": split != "train",
            "not_held_out": ~split.isin("val", "test"),
            "no_split": split.isNull(),
        },
        required=("row_id", "Class", "split"),
    )
    contract.watched(split_frames(spark, sf_dir)).select("row_id", "Class", "split").write.parquet(scratch_path(spark, "watched"))
    return contract.report(spark)


@query("f20_scoring_throughput", "SELECT count(*) AS frames, true AS measured FROM events")
def scoring_throughput(spark, sf_dir):
    """Frames scored by the stored detector and whether their rate was measured (see ``measured_scoring``)."""
    detector = stored_detector(spark, sf_dir)
    scored = mlp.predictions(detector.model, mlp.frame_inputs(st.labelled(spark, sf_dir), detector.stats))
    rate = mlp.measured_scoring(scored, scratch_path(spark, "scored"))
    return rate.select("frames", ((F.col("ms_per_frame") > 0) & (F.col("frames_per_second") > 0)).alias("measured"))
