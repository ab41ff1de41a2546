"""CAN captures seen through the driver's tables.

``events`` stands in for a bus log: an event is a frame, a user group a capture.
Everything is a projection of the given tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from canlake.functions.hexfields import pad_left
from canlake.functions.labels import class_id
from canlake.operators.deltas import with_delta_id, with_deltatime
from canlake.operators.ordering import Layout, lay_out
from canlake.schemas import BYTE_COLUMNS, label_schema
from canlake.storage import scratch_path, settle

WINDOW, STRIDE = 16, 8
FIVE = label_schema("five_class")
# Sessions that the tables of every scale have; a hold-out names them and fails on any other.
VAL_SESSIONS = ["cap_1_S", "cap_3_S"]
TEST_SESSIONS = ["cap_2_D", "cap_4_D"]

# What the order of frames and their times take; queries on times alone lay out nothing else.
TIMES = ("row_id", "session_id", "Timestamp")

_layouts: dict[tuple[str, ...], Layout] = {}
_rendered: dict[tuple[str, str, int], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_text(value: Column, width: int) -> Column:
    """What ``format_string("%0<width>X")`` gives, without a formatter for each value."""
    text = pad_left(F.hex(value.cast("long")), width)
    return F.coalesce(text, F.lit("NULL"))


def seconds_text(time: Column) -> Column:
    """What ``format_string("%.6f")`` gives for times of whole microseconds."""
    micros = F.round(time * F.lit(1e6)).cast("long")
    size, million = F.abs(micros), F.lit(1_000_000).cast("long")
    whole = ((size - size % million) / million).cast("long")
    text = F.concat(F.when(micros < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.lpad((size % million).cast("string"), 6, "0"))
    return F.coalesce(text, F.lit("null"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical frames; a query reads only the event columns it needs.

    The properties are parsed in a projection of their own, so that eight byte
    columns do not parse them eight times.
    """
    event, user = F.col("event_id"), F.col("user_id")
    k, dlc = F.col("k"), F.col("dlc")
    day = F.dayofmonth("ts") % 15
    attack_number = F.when(day.isin(3, 6, 9, 12), day / 3).otherwise(0).cast("long")
    values = [
        F.lit(5).cast("long"),
        F.floor(event / 16) % 256,
        user % 4 + attack_number * 40,  # an attack leaves its mark on the third byte
        *[(event * (2 * i + 1) + k * 17) % 256 for i in range(3, 8)],
    ]
    attack = (
        F.when(day == 3, "Flooding").when(day == 6, "Fuzzing").when(day == 9, "Spoofing").when(day == 12, "Replay")
    )
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("long"))
        .withColumn("dlc", F.when(k % 5 == 0, k % 8).otherwise(8).cast("int"))
        .select(
            event.alias("row_id"),
            F.concat(
                F.lit("cap_"), (user % 15).cast("string"), F.when(user % 2 == 0, "_D").otherwise("_S")
            ).alias("session_id"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).alias("Timestamp"),
            hex_text((k * 37) % 2048, 3).alias("Arbitration_ID"),
            dlc.alias("DLC"),
            *[
                F.when(F.lit(i) < dlc, hex_text(value, 2)).otherwise("PAD").alias(name)
                for i, (name, value) in enumerate(zip(BYTE_COLUMNS, values))
            ],
            F.coalesce(attack, F.lit("Normal")).alias("attack_type"),
        )
    )


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical frames on disk, rendered once per application and table; for queries that read them several times."""
    key = (spark.sparkContext.applicationId, sf_dir, table(spark, sf_dir, "events").count())
    if key not in _rendered:
        _rendered[key] = settle(frames(spark, sf_dir), "rendered-frames")
    return _rendered[key]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("Class", class_id("five_class"))


def layout(spark: SparkSession, sf_dir: str, *columns: str) -> Layout:
    """The labelled frames, ordered on disk once per application and table folder.

    With ``columns`` only these are rendered, moved and written, unless all are on disk already.
    """
    whole, key = (spark.sparkContext.applicationId, sf_dir), (spark.sparkContext.applicationId, sf_dir, *columns)
    key = whole if whole in _layouts else key
    if key not in _layouts:
        frames = labelled(spark, sf_dir)
        _layouts[key] = lay_out(frames.select(*columns) if columns else frames)
    return _layouts[key]


def positioned(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return layout(spark, sf_dir, *columns).frames


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_delta_id(with_deltatime(positioned(spark, sf_dir)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated classifier output: one in ten frames gets the next class."""
    base = labelled(spark, sf_dir)
    wrong = F.col("row_id") % 10 == 0
    return base.select(
        "row_id",
        "session_id",
        F.col("Class").alias("y_true"),
        F.when(wrong, (F.col("Class") + 1) % 5).otherwise(F.col("Class")).cast("int").alias("y_pred"),
        (((F.col("row_id") * 7919) % 1000) / F.lit(2000.0) + F.when(F.col("Class") > 0, 0.3).otherwise(0.0)).alias("score"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select(
        "row_id",
        "session_id",
        (F.col("y_true") > 0).cast("int").alias("attack"),
        (F.col("score") > 0.5).cast("int").alias("flagged"),
        "score",
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("logits"), F.col("label").alias("target")
    )


def session_number(session: Column) -> Column:
    return F.split(session, "_").getItem(1).cast("int")


# Capture names given to the stand-in sessions, by session number.
ROAD_NAMES = (
    "correlated_signal", "fuzzing", "max_engine_coolant_temp", "max_speedometer", "reverse_light_on",
    "reverse_light_off", "accelerator_attack_drive",
)
MIRGU_NAMES = (
    "benign/day", "masquerade_attacks/brake", "suspension_attacks/gear", "real_attacks/fuzzing_run",
    "real_attacks/dos_run", "real_attacks/replay_run", "real_attacks/steering",
)
SURVIVAL_NAMES = ("FreeDriving", "Flooding", "Fuzzy", "Malfunction")
HCRL_NAMES = ("DoS", "Fuzzy", "gear", "RPM", "normal_run")


def named(session: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), session_number(session) % len(names) + 1)


def capture_path(dialect: str, session: Column) -> Column:
    if dialect == "road_raw":
        masquerade = F.when(session_number(session) % 2 == 1, "_masquerade").otherwise("")
        folder = F.when(session_number(session) == 14, "ambient").otherwise("attacks")
        return F.concat(F.lit("/road/"), folder, F.lit("/"), named(session, ROAD_NAMES), F.lit("_"), session, masquerade, F.lit(".log"))
    if dialect == "can_mirgu":
        return F.concat(F.lit("/mirgu/"), named(session, MIRGU_NAMES), F.lit("_"), session, F.lit(".log"))
    if dialect == "survival_analysis":
        return F.concat(F.lit("/survival/"), named(session, SURVIVAL_NAMES), F.lit("_"), session, F.lit(".txt"))
    if dialect == "hcrl_carhacking":
        return F.concat(F.lit("/hcrl/"), named(session, HCRL_NAMES), F.lit("_"), session, F.lit(".csv"))
    return F.concat(F.lit("/captures/"), session, F.lit(".csv"))


def capture_files(spark: SparkSession, sf_dir: str, dialect: str, base: DataFrame | None = None) -> DataFrame:
    """One row per capture of a dialect; ``base`` are frames at hand."""
    session, base = F.col("session_id"), frames(spark, sf_dir) if base is None else base
    return base.select("session_id").distinct().select(capture_path(dialect, session).alias("path"), "session_id")


def present_bytes(separator: str) -> Column:
    return F.concat_ws(separator, *[F.when(F.col(c) != "PAD", F.col(c)) for c in BYTE_COLUMNS])


def log_lines(spark: SparkSession, sf_dir: str, dialect: str, base: DataFrame | None = None) -> DataFrame:
    """The frames rendered as log lines of a dialect (header lines included); ``base`` are frames at hand."""
    time, flag = F.col("time"), F.col("flag")
    comma_bytes, spaced_bytes = F.col("comma_bytes"), F.col("spaced_bytes")
    comma_tail = F.when(comma_bytes == "", "").otherwise(F.concat(F.lit(","), comma_bytes))
    can_id, dlc = F.col("Arbitration_ID"), F.col("DLC").cast("string")
    value = {
        "road_raw": F.concat(F.lit("("), time, F.lit(") can0 "), can_id, F.lit("#"), present_bytes("")),
        "can_mirgu": F.concat(
            F.lit("("), time, F.lit(") can0 "), can_id, F.lit("#"), present_bytes(""), F.lit(" "),
            F.when(flag == "T", "1").otherwise("0"),
        ),
        "hcrl_carhacking": F.concat(time, F.lit(","), F.lower(can_id), F.lit(","), dlc, comma_tail, F.lit(","), flag),
        "hcrl_text": F.concat(
            F.lit("Timestamp: "), time, F.lit("        ID: 0"), F.lower(can_id), F.lit("    000    DLC: "), dlc,
            F.lit("    "), F.lower(spaced_bytes),
        ),
        "survival_analysis": F.when(
            (F.col("row_id") % 2 == 0) & (F.col("DLC") > 1),
            F.concat(time, F.lit(",0"), can_id, F.lit(","), dlc, F.lit(","), F.lower(spaced_bytes)),
        ).otherwise(
            F.concat(time, F.lit(",0"), can_id, F.lit(","), dlc, comma_tail, F.lit(","), flag)
        ),
        "car_hacking_attack_defense": F.concat(
            time, F.lit(",0x"), F.lower(can_id), F.lit(","), dlc, F.lit(","), spaced_bytes, F.lit(","),
            F.when(flag == "T", "Attack").otherwise("Normal"),
            F.when(has_subclass(F.col("session_id")), F.concat(F.lit(","), F.col("attack_type"))).otherwise(""),
        ),
        "ciciov2024": F.concat(
            can_id, F.lit(","),
            F.when(F.col("DLC") == 8, "").otherwise(F.concat(F.lit("["), dlc, F.lit("]"))),
            *[F.concat(F.lit(","), F.when(F.col(c) != "PAD", F.lower(F.col(c))).otherwise("")) for c in BYTE_COLUMNS],
            F.when(flag == "T", ",ATTACK,").otherwise(",BENIGN,"), F.lower(F.col("attack_type")),
        ),
    }[dialect]
    family = "hcrl_carhacking" if dialect == "hcrl_text" else dialect
    base = frames(spark, sf_dir) if base is None else base
    lines = base.withColumns(
        {
            "time": seconds_text(F.col("Timestamp")),
            "flag": F.when(F.col("attack_type") != "Normal", "T").otherwise("R"),
            "comma_bytes": present_bytes(","),
            "spaced_bytes": present_bytes(" "),
        }
    ).select(
        capture_path(family, F.col("session_id")).alias("path"),
        F.lit(0).cast("long").alias("file_block"),
        F.col("row_id").alias("line_key"),
        F.explode(F.array(value)).alias("value"),  # rendered once, filters stay above it
        F.col("session_id").alias("capture"),
    )
    header = {
        "car_hacking_attack_defense": F.when(
            has_subclass(F.col("session_id")), "Timestamp,Arbitration_ID,DLC,Data,Class,SubClass"
        ).otherwise("Timestamp,Arbitration_ID,DLC,Data,Class"),
        "ciciov2024": F.lit("ID,DLC," + ",".join(f"DATA_{i}" for i in range(8)) + ",label,specific_class"),
    }.get(dialect)
    if header is not None:
        heads = base.select("session_id").distinct().select(
            capture_path(family, F.col("session_id")).alias("path"),
            F.lit(0).cast("long").alias("file_block"),
            F.lit(-1).cast("long").alias("line_key"),
            header.alias("value"),
            F.col("session_id").alias("capture"),
        )
        lines = heads.unionByName(lines)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return lines.withColumn("session_id", stem)


def write_captures(spark: SparkSession, sf_dir: str, dialect: str, base: DataFrame | None = None) -> str:
    """The frames as capture files of a dialect, named as its corpus names them; gives the folder.

    A capture is one file, so one task writes it; the files, one for each session, then
    get their names.
    """
    raw, folder = scratch_path(spark, "raw-lines"), scratch_path(spark, "raw")
    lines = log_lines(spark, sf_dir, dialect, base)
    lines.repartition("capture").sortWithinPartitions("capture", "line_key").select("capture", "value").write.partitionBy("capture").text(raw)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(raw).getFileSystem(spark._jsc.hadoopConfiguration())
    names = capture_files(spark, sf_dir, dialect, base).collect()  # one row for each session
    for row in names:
        target = path(folder + row["path"])
        fs.mkdirs(target.getParent())
        part = next(s.getPath() for s in fs.listStatus(path(f"{raw}/capture={row['session_id']}")) if s.getLen())
        if not fs.rename(part, target):
            raise OSError(f"cannot name {target}")
    return folder


def has_subclass(session: Column) -> Column:
    """Some captures of the header CSV come without the sub-label column."""
    return session_number(session) % 3 != 0


def stray_text(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """Whole documents as lines that no dialect can parse, spread over the captures."""
    number = F.col("doc_id") % 15
    session = F.concat(F.lit("cap_"), number.cast("string"), F.when(F.col("doc_id") % 2 == 0, "_D").otherwise("_S"))
    docs = table(spark, sf_dir, "documents").select(
        session.alias("capture"), (F.col("doc_id") + F.lit(1 << 40)).alias("line_key"),
        F.translate("text", "\r\n,", "   ").alias("value"),
    )
    path = capture_path(dialect, F.col("capture"))
    return docs.select(
        path.alias("path"), F.lit(0).cast("long").alias("file_block"), "line_key", "value", "capture",
        F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "").alias("session_id"),
    )


def injections(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Injection interval, pattern and identifier per ROAD capture.

    The interval covers 10 % to 30 % of the capture; odd captures target their most
    frequent identifier, the others any.
    """
    per_id = (frames(spark, sf_dir) if base is None else base).groupBy("session_id", "Arbitration_ID").agg(
        F.count(F.lit(1)).alias("n"), F.min("Timestamp").alias("t_min"), F.max("Timestamp").alias("t_max")
    )
    facts = per_id.groupBy("session_id").agg(
        (F.max("t_max") - F.min("t_min")).alias("span"),
        F.min_by("Arbitration_ID", F.struct((-F.col("n")).alias("n"), "Arbitration_ID")).alias("busiest"),
    )
    path = capture_path("road_raw", F.col("session_id"))
    return facts.select(
        F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "").alias("session_id"),
        F.round(F.col("span") * 0.1, 3).alias("t_lo"),
        F.round(F.col("span") * 0.3, 3).alias("t_hi"),
        F.lit("05XXXXXXXXXXXXXX").alias("pattern"),
        F.when(session_number(F.col("session_id")) % 2 == 0, "XXX").otherwise(F.col("busiest")).alias("target"),
    )


def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-epoch metrics out of the orders table (100 epochs)."""
    price = F.col("o_totalprice")
    return (
        table(spark, sf_dir, "orders")
        .groupBy((F.col("o_orderkey") % 100).alias("epoch"))
        .agg(
            F.round(F.avg(price) / 1000.0, 6).alias("loss"),
            F.round(F.avg(price / 600000.0), 6).alias("accuracy"),
            F.round(F.min(price) / 600000.0, 6).alias("precision_macro"),
            F.round(F.max(price) / 600000.0, 6).alias("recall_macro"),
            F.round(F.avg((price - 1000.0) / 600000.0), 6).alias("f1_macro"),
        )
        .select(
            "epoch", "loss", "accuracy", "precision_macro", "recall_macro", "f1_macro",
            *[
                F.round(F.col(m) * 0.9, 6).alias(f"val_{m}")
                for m in ("loss", "accuracy", "precision_macro", "recall_macro", "f1_macro")
            ],
        )
    )
