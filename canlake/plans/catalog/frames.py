"""Labels, time features and statistics of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from canlake.functions.labels import class_id, is_benign
from canlake.operators import audits, deltas, normalise, ordering, rolling, traffic
from canlake.plans import standin as st
from canlake.plans.catalog.registry import query
from canlake.plans.catalog.twins import BYTES, FRAMES, LABELLED, PREPARED, number, zero
from canlake.schemas import BYTE_COLUMNS

LONG = "long"


@query(
    "p11_class_ids_by_schema",
    f"""WITH {LABELLED}, schemas(name, attack_type, id) AS (VALUES
      ('five_class','Normal',0), ('five_class','Flooding',1), ('five_class','Fuzzing',2), ('five_class','Spoofing',3), ('five_class','Replay',4),
      ('SurvivalAnalysis','Normal',0), ('SurvivalAnalysis','Flooding',1), ('SurvivalAnalysis','Fuzzing',2),
      ('CANMIRGU','Normal',0), ('CANMIRGU','Fuzzing',2), ('CANMIRGU','Spoofing',3), ('CANMIRGU','Replay',4),
      ('road','Normal',0), ('road','Fuzzing',2), ('HCRLCarHacking','Normal',0))
    SELECT n.name AS schema_name, f.attack_type, CAST(s.id AS INTEGER) AS class_id, count(*) AS rows
    FROM frames f CROSS JOIN (SELECT DISTINCT name FROM schemas) n
    LEFT JOIN schemas s ON s.name = n.name AND s.attack_type = f.attack_type
    GROUP BY n.name, f.attack_type, s.id""",
)
def class_ids_by_schema(spark, sf_dir):
    variants = [
        ("five_class", None), ("SurvivalAnalysis", None), ("CANMIRGU", "extended"),
        ("road", "fabrication"), ("HCRLCarHacking", None),
    ]
    counts = st.frames(spark, sf_dir).groupBy("attack_type").agg(F.count(F.lit(1)).alias("rows"))
    ids = F.array(
        *[F.struct(F.lit(n).alias("schema_name"), class_id(n, v, strict=False).alias("class_id")) for n, v in variants]
    )
    return counts.select("attack_type", "rows", F.inline(ids))


@query(
    "p12_binary_labels",
    f"""WITH {FRAMES} SELECT session_id, sum(CASE WHEN attack_type <> 'Normal' THEN 1 ELSE 0 END)::BIGINT AS attack_frames,
        count(*) AS frames FROM frames GROUP BY session_id""",
)
def binary_labels(spark, sf_dir):
    return (
        st.frames(spark, sf_dir)
        .withColumn("Class", class_id("binary"))
        .groupBy("session_id")
        .agg(F.sum("Class").cast(LONG).alias("attack_frames"), F.count(F.lit(1)).alias("frames"))
    )


@query(
    "p13_ten_state_labels",
    f"""WITH {LABELLED} SELECT CAST("Class" + CASE WHEN regexp_matches(session_id, '_S(_|$)') THEN 5 ELSE 0 END AS INTEGER) AS "Class",
        count(*) AS rows FROM labelled GROUP BY 1""",
)
def ten_state_labels(spark, sf_dir):
    return (
        st.frames(spark, sf_dir)
        .withColumn("Class", class_id("ten_state_attack"))
        .groupBy("Class")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    "p14_session_id_time_slice",
    f"""WITH {LABELLED} SELECT row_id, "Timestamp", "Class", DLC FROM labelled
        WHERE session_id = 'cap_3_S' AND Arbitration_ID IN (SELECT min(Arbitration_ID) FROM labelled WHERE session_id = 'cap_3_S')
          AND "Timestamp" BETWEEN 1704153600 AND 1706140800""",
)
def session_id_time_slice(spark, sf_dir):
    base = st.labelled(spark, sf_dir)
    smallest = base.where("session_id = 'cap_3_S'").agg(F.min("Arbitration_ID").alias("v")).first()["v"] or ""
    return traffic.slice_of(base, "cap_3_S", smallest, 1704153600.0, 1706140800.0).select(
        "row_id", "Timestamp", "Class", "DLC"
    )


@query(
    "p15_attack_frames",
    f"""WITH {LABELLED} SELECT row_id, session_id, "Class" FROM labelled WHERE "Class" NOT IN (0)""",
)
def attack_frames(spark, sf_dir):
    return traffic.only_benign(st.labelled(spark, sf_dir), st.FIVE, negate=True).select("row_id", "session_id", "Class")


@query(
    "p16_active_bytes",
    f"""WITH {FRAMES} SELECT session_id, Arbitration_ID,
        array_to_string(list_slice({BYTES}, 1, dlc), ' ') AS active
        FROM (SELECT session_id, Arbitration_ID, min_by(DLC, row_id) AS dlc FROM frames GROUP BY session_id, Arbitration_ID)""",
)
def active_bytes(spark, sf_dir):
    found = traffic.active_bytes(st.positioned(spark, sf_dir), ["session_id", "Arbitration_ID"])
    return found.withColumn("active", F.array_join("active", " "))


@query(
    "j01_class_names_of_frames",
    f"""WITH {LABELLED} SELECT CASE "Class" WHEN 0 THEN 'Normal' WHEN 1 THEN 'Flooding' WHEN 2 THEN 'Fuzzing' WHEN 3 THEN 'Spoofing'
        ELSE 'Replay' END AS class_name, count(*) AS rows FROM labelled GROUP BY 1""",
)
def class_names_of_frames(spark, sf_dir):
    names = [(i, n) for i, n in enumerate(st.FIVE.class_names)]
    dim = spark.createDataFrame(names, "Class int, class_name string")
    return st.labelled(spark, sf_dir).join(dim, "Class").groupBy("class_name").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "j05_attack_only_ids",
    f"""WITH {LABELLED} SELECT Arbitration_ID, CAST('0x' || Arbitration_ID AS INTEGER) AS id_number FROM labelled
        GROUP BY Arbitration_ID HAVING min(CASE WHEN "Class" = 0 THEN 0 ELSE 1 END) = 1""",
)
def attack_only_ids(spark, sf_dir):
    return traffic.attack_only_ids(st.labelled(spark, sf_dir), st.FIVE)


@query(
    "j05_attack_only_marks",
    f"""WITH {LABELLED}, marked AS (SELECT '0' || Data_2 AS mark, "Class" FROM labelled WHERE Data_2 <> 'PAD')
        SELECT mark AS Arbitration_ID, CAST('0x' || mark AS INTEGER) AS id_number FROM marked GROUP BY mark HAVING min(CASE WHEN "Class" = 0 THEN 0 ELSE 1 END) = 1""",
)
def attack_only_marks(spark, sf_dir):
    """The third byte as identifier: attacks use values of their own."""
    frames = st.labelled(spark, sf_dir).where("Data_2 <> 'PAD'")
    return traffic.attack_only_ids(frames.withColumn("Arbitration_ID", F.concat(F.lit("0"), "Data_2")), st.FIVE)


@query(
    "a01_class_distribution",
    f"""WITH {LABELLED} SELECT "Class", count(*) AS rows, round(count(*) / sum(count(*)) OVER ()::DOUBLE * 100, 4) AS percentage
        FROM labelled GROUP BY "Class" """,
)
def class_distribution(spark, sf_dir):
    return audits.class_distribution(st.labelled(spark, sf_dir), "Class")


@query(
    "a02_rows_per_attack_type",
    f"""WITH {FRAMES} SELECT attack_type, count(*) AS rows, round(count(*) / sum(count(*)) OVER ()::DOUBLE * 100, 2) AS percentage
        FROM frames GROUP BY attack_type""",
)
def rows_per_attack_type(spark, sf_dir):
    return traffic.rows_per_attack_type(st.frames(spark, sf_dir))


@query(
    "a03_ids_per_attack_type",
    f"WITH {FRAMES} SELECT attack_type, count(DISTINCT Arbitration_ID) AS ids FROM frames GROUP BY attack_type",
)
def ids_per_attack_type(spark, sf_dir):
    return traffic.ids_per_attack_type(st.frames(spark, sf_dir))


@query(
    "a04_classes_per_id",
    f"""WITH {FRAMES} SELECT Arbitration_ID, string_agg(attack_type, ', ' ORDER BY attack_type) AS classes
        FROM (SELECT DISTINCT Arbitration_ID, attack_type FROM frames) GROUP BY Arbitration_ID""",
)
def classes_per_id(spark, sf_dir):
    return traffic.classes_per_id(st.frames(spark, sf_dir))


@query(
    "a05_mean_frequency_per_id",
    f"""WITH {PREPARED} SELECT Arbitration_ID, round(avg(Delta_Id), 6) AS mean_gap, round(1.0 / avg(Delta_Id), 9) AS mean_freq_hz,
        round(1000.0 / avg(Delta_Id), 6) AS mean_freq_x1000 FROM prepared WHERE Delta_Id > 0 AND "Class" = 0 GROUP BY Arbitration_ID""",
)
def mean_frequency_per_id(spark, sf_dir):
    frames = deltas.with_delta_id(st.positioned(spark, sf_dir))
    found = traffic.frequency_per_id(traffic.only_benign(frames, st.FIVE))
    return found.select(
        "Arbitration_ID", F.round("mean_gap", 6).alias("mean_gap"), F.round("mean_freq_hz", 9).alias("mean_freq_hz"),
        F.round("mean_freq_x1000", 6).alias("mean_freq_x1000"),
    )


@query(
    "a06_frames_per_id",
    f"WITH {FRAMES} SELECT Arbitration_ID, count(*) AS frames, max(DLC) AS max_dlc FROM frames GROUP BY Arbitration_ID",
)
def frames_per_id(spark, sf_dir):
    return traffic.frames_per_id(st.frames(spark, sf_dir))


@query(
    "a07_session_summary",
    f"""WITH {LABELLED} SELECT session_id, count(*) AS frames, count(DISTINCT "Class")::INTEGER AS classes,
        min("Timestamp") AS t_first, max("Timestamp") AS t_last, max("Timestamp") - min("Timestamp") AS duration,
        COALESCE(string_agg(DISTINCT CASE WHEN "Class" <> 0 THEN "Class"::VARCHAR END, ' ' ORDER BY CASE WHEN "Class" <> 0 THEN "Class"::VARCHAR END), '') AS attack_classes
        FROM labelled GROUP BY session_id""",
)
def session_summary(spark, sf_dir):
    found = audits.session_summary(st.labelled(spark, sf_dir), st.FIVE)
    return found.withColumn("attack_classes", F.array_join(F.transform("attack_classes", lambda c: c.cast("string")), " "))


@query(
    "a27_present_classes",
    f"""WITH {LABELLED} SELECT string_agg(c::VARCHAR, ' ' ORDER BY c) AS labels, max(c) + 1 = count(*) AS contiguous
        FROM (SELECT DISTINCT "Class" AS c FROM labelled)""",
)
def present_classes(spark, sf_dir):
    found = traffic.present_classes(st.labelled(spark, sf_dir))
    return found.withColumn("labels", F.array_join(F.transform("labels", lambda c: c.cast("string")), " "))


STATS_COLUMNS = ["DLC", *BYTES]


def _numeric_sql(name: str) -> str:
    return f"{name}::DOUBLE" if name == "DLC" else f"({zero(name)})::DOUBLE"


@query(
    "a12_frame_norm_stats",
    f"WITH {FRAMES} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({_numeric_sql(c)}), 6) AS mean,
        round(CASE WHEN stddev_pop({_numeric_sql(c)}) < 1e-8 THEN 1.0 ELSE stddev_pop({_numeric_sql(c)}) END, 6) AS std FROM frames"""
        for c in STATS_COLUMNS
    ),
)
def frame_norm_stats(spark, sf_dir):
    found = normalise.frame_stats(st.frames(spark, sf_dir))
    return found.select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "f04_scaled_numeric_fields",
    f"WITH {FRAMES}, stats AS (SELECT "
    + ", ".join(
        f"avg({_numeric_sql(c)}) AS {c}_m, CASE WHEN stddev_pop({_numeric_sql(c)}) < 1e-8 THEN 1.0 ELSE stddev_pop({_numeric_sql(c)}) END AS {c}_s"
        for c in STATS_COLUMNS
    )
    + " FROM frames WHERE attack_type = 'Normal') SELECT row_id, "
    + ", ".join(f"round(({_numeric_sql(c)} - {c}_m) / {c}_s, 6) + 0.0 AS z_{c}" for c in STATS_COLUMNS)
    + " FROM frames, stats",
)
def scaled_numeric_fields(spark, sf_dir):
    base = st.frames(spark, sf_dir)
    stats = normalise.fit(normalise.frame_stats(base.where("attack_type = 'Normal'")))
    scaled = normalise.scaled_values(stats)
    return normalise.decoded(base).select(
        "row_id",
        *[(F.round(z, 6) + 0.0).alias(f"z_{c}") for c, z in zip(normalise.NUMERIC_COLUMNS, scaled)],
    )


@query("w01_deltatime", f"WITH {PREPARED} SELECT row_id, session_id, round(Deltatime, 6) AS Deltatime FROM prepared")
def deltatime(spark, sf_dir):
    return deltas.with_deltatime(st.positioned(spark, sf_dir, *st.TIMES)).select(
        "row_id", "session_id", F.round("Deltatime", 6).alias("Deltatime")
    )


@query(
    "w02_delta_id",
    f"WITH {PREPARED} SELECT row_id, session_id, Arbitration_ID, round(Delta_Id, 6) AS Delta_Id FROM prepared",
)
def delta_id(spark, sf_dir):
    return deltas.with_delta_id(st.positioned(spark, sf_dir)).select(
        "row_id", "session_id", "Arbitration_ID", F.round("Delta_Id", 6).alias("Delta_Id")
    )


@query(
    "w03_relative_time",
    f"""WITH {PREPARED} SELECT row_id, round("Timestamp" - t_first, 6) AS relative_time FROM prepared""",
)
def relative_time(spark, sf_dir):
    layout = st.layout(spark, sf_dir, *st.TIMES)
    return deltas.with_relative_time(layout.frames, layout.sessions).select(
        "row_id", F.round("relative_time", 6).alias("relative_time")
    )


ROLL = 50
ROLLED = PREPARED + f""",
rolled AS (
  SELECT *, "Timestamp" - COALESCE(lag("Timestamp", {ROLL}) OVER (PARTITION BY session_id ORDER BY pos), t_first) AS span,
         count(*) OVER (PARTITION BY session_id, Arbitration_ID ORDER BY pos RANGE BETWEEN {ROLL - 1} PRECEDING AND CURRENT ROW) / {ROLL}::DOUBLE AS freq_id
  FROM prepared
),
loads AS (
  SELECT *, least(greatest((CASE WHEN span > 1e-6 THEN {ROLL}::DOUBLE / greatest(span, 1e-4::DOUBLE) ELSE 0.0::DOUBLE END) / 5000.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS fixed_load,
         CASE WHEN span > 1e-6 THEN {ROLL}::DOUBLE / span ELSE 0.0::DOUBLE END AS rate
  FROM rolled
),
peaks AS (
  SELECT *, rate / CASE WHEN max(rate) OVER (PARTITION BY session_id) > 0 THEN max(rate) OVER (PARTITION BY session_id) ELSE 1.0 END AS max_load
  FROM loads
)"""


@query("w04_rolling_id_frequency", f"WITH {ROLLED} SELECT row_id, session_id, freq_id FROM rolled")
def rolling_id_frequency(spark, sf_dir):
    return rolling.with_rolling(st.positioned(spark, sf_dir), ROLL).select("row_id", "session_id", "freq_id")


@query(
    "w05_bus_load_fixed_scale",
    f"WITH {ROLLED} SELECT row_id, session_id, round(fixed_load, 9) AS bus_load FROM loads",
)
def bus_load_fixed_scale(spark, sf_dir):
    return rolling.with_fixed_load(st.layout(spark, sf_dir, *st.TIMES), ROLL).select(
        "row_id", "session_id", F.round("bus_load", 9).alias("bus_load")
    )


@query(
    "w06_bus_load_session_max",
    f"WITH {ROLLED} SELECT row_id, session_id, round(max_load, 9) AS bus_load FROM peaks",
)
def bus_load_session_max(spark, sf_dir):
    return rolling.with_session_max_load(st.layout(spark, sf_dir, *st.TIMES), ROLL).select(
        "row_id", "session_id", F.round("bus_load", 9).alias("bus_load")
    )


@query(
    "w07_time_progress",
    f"""WITH {PREPARED} SELECT row_id, round(("Timestamp" - t_first) / greatest(t_last - t_first, 1e-6::DOUBLE), 9) AS progress,
        round(("Timestamp" - t_first) / CASE WHEN t_last - t_first <= 1e-6 THEN 1.0 ELSE t_last - t_first END, 9) AS progress_stretched
        FROM prepared""",
)
def time_progress(spark, sf_dir):
    layout = st.layout(spark, sf_dir, *st.TIMES)
    return rolling.with_session_bounds(layout.frames, layout).select(
        "row_id",
        F.round(rolling.progress(False), 9).alias("progress"),
        F.round(rolling.progress(True), 9).alias("progress_stretched"),
    )


FIVE_DIGITS = (9, 6, 9, 9, 9)


def _five_sql(load: str, span: str) -> str:
    parts = [
        "CAST('0x' || Arbitration_ID AS INTEGER) / 2047.0::DOUBLE", "Delta_Id", "freq_id", load,
        f"(\"Timestamp\" - t_first) / {span}",
    ]
    return ", ".join(f"round({p}, {FIVE_DIGITS[i]}) AS f{i}" for i, p in enumerate(parts))


@query(
    "f15_five_features_fixed",
    f"WITH {ROLLED} SELECT row_id, {_five_sql('fixed_load', 'greatest(t_last - t_first, 1e-6::DOUBLE)')} FROM loads",
)
def five_features_fixed(spark, sf_dir):
    return _five(rolling.with_five_features(st.layout(spark, sf_dir), ROLL))


@query(
    "f15_five_features_session_max",
    f"WITH {ROLLED} SELECT row_id, {_five_sql('max_load', 'CASE WHEN t_last - t_first <= 1e-6 THEN 1.0 ELSE t_last - t_first END')} FROM peaks",
)
def five_features_session_max(spark, sf_dir):
    return _five(rolling.with_five_features(st.layout(spark, sf_dir), ROLL, session_max=True))


def _five(df):
    return df.select("row_id", *[F.round(F.get("features", F.lit(i)), d).alias(f"f{i}") for i, d in enumerate(FIVE_DIGITS)])


@query(
    "w13_first_rows_with_delta",
    f"""WITH {PREPARED} SELECT count(*) AS violations FROM prepared WHERE pos = 0 AND Deltatime <> 0""",
)
def first_rows_with_delta(spark, sf_dir):
    found = deltas.nonzero_first_deltas(deltas.with_deltatime(st.positioned(spark, sf_dir, *st.TIMES)))
    return found.agg(F.count(F.lit(1)).alias("violations"))


@query(
    "t01_canonical_order",
    f"""WITH {PREPARED} SELECT row_id, session_id, pos FROM prepared""",
)
def canonical_order(spark, sf_dir):
    return ordering.in_canonical_order(st.positioned(spark, sf_dir, *st.TIMES)).select("row_id", "session_id", "pos")


@query(
    "t02_busiest_ids",
    f"""WITH {FRAMES} SELECT Arbitration_ID, count(*) AS frames, max(DLC) AS max_dlc FROM frames GROUP BY Arbitration_ID
        ORDER BY frames DESC, Arbitration_ID LIMIT 15""",
)
def busiest_ids(spark, sf_dir):
    return traffic.busiest_ids(st.frames(spark, sf_dir), 15)


@query(
    "d10_null_audit",
    f"""WITH {LABELLED} SELECT 'Class' AS "column", count(*) FILTER ("Class" IS NULL) AS nulls FROM labelled
        UNION ALL SELECT 'session_id', count(*) FILTER (session_id IS NULL) FROM labelled""",
)
def null_audit(spark, sf_dir):
    return audits.null_audit(st.labelled(spark, sf_dir), ["Class", "session_id"])


@query(
    "w11_class_ordinals",
    f"""WITH {LABELLED} SELECT row_id, "Class", row_number() OVER (PARTITION BY "Class" ORDER BY row_id) - 1 AS ordinal FROM labelled""",
)
def class_ordinals(spark, sf_dir):
    return ordering.with_ordinal(
        st.labelled(spark, sf_dir).select("row_id", "Class"), ["Class"], "row_id"
    ).select("row_id", "Class", "ordinal")
