"""Raw dialects rendered from the stand-in frames and parsed back, plus table I/O."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from canlake.functions import labels
from canlake.functions.encodings import id_value
from canlake.operators import audits, splits
from canlake.plans import standin as st
from canlake.plans.catalog.registry import query
from canlake.plans.catalog.twins import BYTES, FRAMES, LABELLED, sql_list
from canlake.schemas import BYTE_COLUMNS
from canlake.sources import candump, captures, delimited, discovery, tables
from canlake.sources.parsing import accepted, captures_without_frames, reject_counts, staged
from canlake.storage import scratch_path


def sql_names(names, number="cap_no") -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][{number} % {len(names)} + 1]"


def road_stem(session="session_id", number="cap_no") -> str:
    return f"{sql_names(st.ROAD_NAMES, number)} || '_' || {session} || CASE WHEN {number} % 2 = 1 THEN '_masquerade' ELSE '' END"


def mirgu_stem(session="session_id", number="cap_no") -> str:
    last = [n.split("/")[-1] for n in st.MIRGU_NAMES]
    return f"{sql_names(last, number)} || '_' || {session}"


def survival_stem(session="session_id", number="cap_no") -> str:
    """Capture names of the survival corpus."""
    return f"{sql_names(st.SURVIVAL_NAMES, number)} || '_' || {session}"


#: Label of a survival frame: only the flagged form of the line carries it.
SURVIVAL_LABEL = """CASE WHEN attack_type <> 'Normal' AND NOT (row_id % 2 = 0 AND DLC > 1) THEN ['Normal','Flooding','Fuzzing','Malfunction'][cap_no % 4 + 1] ELSE 'Normal' END"""
PAYLOAD = "||".join(f"CASE WHEN {b} = 'PAD' THEN '' ELSE {b} END" for b in BYTES)
SLICED = ", ".join(f"substr(p, {2 * i + 1}, 2) AS Data_{i}" for i in range(8))
OUT = ["row_id", "session_id", "Timestamp", "Arbitration_ID", "DLC", *BYTE_COLUMNS, "attack_type"]


def shown(parsed, time=True):
    """Canonical columns of the good lines, keyed by the line's place."""
    good = accepted(parsed).withColumnRenamed("line_key", "row_id")
    good = good.withColumn("DLC", F.col("DLC").cast("int"))
    if time:
        good = good.withColumn("Timestamp", F.round("Timestamp", 6))
    return good.select(*[c for c in OUT if time or c != "Timestamp"])


FILES_ROAD = f"""files AS (SELECT DISTINCT session_id, cap_no, '/road/' || CASE WHEN cap_no = 14 THEN 'ambient' ELSE 'attacks' END || '/' || {road_stem()} || '.log' AS path FROM frames)"""
FILES_MIRGU = f"""files AS (SELECT DISTINCT session_id, cap_no, '/mirgu/' || {sql_names(st.MIRGU_NAMES)} || '_' || session_id || '.log' AS path FROM frames)"""


@query(
    "s02_excluded_files",
    f"""WITH {FRAMES}, {FILES_ROAD} SELECT path, regexp_matches(path, '^/road/attacks/fuzzing_[^/]*$') OR path LIKE '/road/ambient/%'
        OR regexp_matches(path, '/attacks/max_speed[^/]*_[DS]_masquerade[.]log$') AS excluded FROM files""",
)
def excluded_files(spark, sf_dir):
    patterns = ["fuzzing_*", "ambient/*", "attacks/max_speed*_[DS]_masquerade.log"]
    return st.capture_files(spark, sf_dir, "road_raw").select(
        "path", discovery.is_excluded(F.col("path"), "/road", patterns).alias("excluded")
    )


@query(
    "s04_road_captures",
    f"""WITH {FRAMES}, {FILES_ROAD} SELECT CASE WHEN cap_no % 2 = 1 THEN 'masquerade' ELSE 'fabrication' END AS variant, path FROM files
        WHERE cap_no <> 14 AND cap_no % 7 <> 6""",
)
def road_captures(spark, sf_dir):
    files = st.capture_files(spark, sf_dir, "road_raw")
    chosen = [
        discovery.select_captures(files, "road_raw", v).select(F.lit(v).alias("variant"), "path")
        for v in ("fabrication", "masquerade")
    ]
    return chosen[0].unionByName(chosen[1])


@query(
    "s05_mirgu_captures",
    f"""WITH {FRAMES}, {FILES_MIRGU} SELECT 'extended' AS variant, path FROM files
        UNION ALL SELECT 'real', path FROM files WHERE cap_no % 7 NOT IN (1, 2)""",
)
def mirgu_captures(spark, sf_dir):
    files = st.capture_files(spark, sf_dir, "can_mirgu")
    chosen = [
        discovery.select_captures(files, "can_mirgu", v).select(F.lit(v).alias("variant"), "path")
        for v in ("real", "extended")
    ]
    return chosen[0].unionByName(chosen[1])


@query(
    "p07_families_from_names",
    f"""WITH {FRAMES}, {FILES_MIRGU} SELECT session_id, ['Normal','Masquerade','Suspension','Fuzzing','DoS','Replay','Spoofing'][cap_no % 7 + 1] AS mirgu,
        ['CS','Fuzzing','MEC','MS','RLOn','RLOff',NULL][cap_no % 7 + 1] AS road, ['Normal','Flooding','Fuzzing','Malfunction'][cap_no % 4 + 1] AS survival,
        ['DoS','Fuzzy','Gear','RPM','Normal'][cap_no % 5 + 1] AS hcrl FROM files""",
)
def families_from_names(spark, sf_dir):
    session = F.col("session_id")
    paths = {d: st.capture_path(d, session) for d in ("can_mirgu", "road_raw", "survival_analysis", "hcrl_carhacking")}
    stems = {d: discovery.file_stem(p) for d, p in paths.items()}
    return st.frames(spark, sf_dir).select("session_id").distinct().select(
        "session_id",
        labels.mirgu_family(paths["can_mirgu"], stems["can_mirgu"]).alias("mirgu"),
        labels.road_family(stems["road_raw"]).alias("road"),
        labels.survival_family(stems["survival_analysis"]).alias("survival"),
        labels.hcrl_family(stems["hcrl_carhacking"]).alias("hcrl"),
    )


@query(
    "s06_attack_defense_csv",
    f"""WITH {FRAMES} SELECT row_id, session_id, round("Timestamp", 6) AS "Timestamp", Arbitration_ID, DLC, {', '.join(BYTES)},
        CASE WHEN cap_no % 3 <> 0 OR attack_type = 'Normal' THEN attack_type ELSE 'Attack' END AS attack_type FROM frames""",
)
def attack_defense_csv(spark, sf_dir):
    return shown(delimited.parse_attack_defense(st.log_lines(spark, sf_dir, "car_hacking_attack_defense")))


@query(
    "s07_ciciov_csv",
    f"WITH {FRAMES} SELECT row_id, session_id, Arbitration_ID, DLC, {', '.join(BYTES)}, upper(attack_type) AS attack_type FROM frames",
)
def ciciov_csv(spark, sf_dir):
    return shown(delimited.parse_ciciov(st.log_lines(spark, sf_dir, "ciciov2024")), time=False)


@query(
    "s08_hcrl_ragged_csv",
    f"""WITH {FRAMES} SELECT row_id, {sql_names(st.HCRL_NAMES)} || '_' || session_id AS session_id, round("Timestamp", 6) AS "Timestamp", Arbitration_ID, DLC, {', '.join(BYTES)},
        CASE WHEN attack_type <> 'Normal' THEN ['DoS','Fuzzy','Gear','RPM','Normal'][cap_no % 5 + 1] ELSE 'Normal' END AS attack_type FROM frames""",
)
def hcrl_ragged_csv(spark, sf_dir):
    return shown(delimited.parse_hcrl(st.log_lines(spark, sf_dir, "hcrl_carhacking")))


@query(
    "s09_hcrl_labelled_text",
    f"""WITH {FRAMES} SELECT row_id, {sql_names(st.HCRL_NAMES)} || '_' || session_id AS session_id, round("Timestamp", 6) AS "Timestamp", Arbitration_ID, DLC, {', '.join(BYTES)},
        'Normal' AS attack_type FROM frames""",
)
def hcrl_labelled_text(spark, sf_dir):
    return shown(delimited.parse_hcrl_text(st.log_lines(spark, sf_dir, "hcrl_text")))


@query(
    "s10_survival_text",
    f"""WITH {FRAMES} SELECT row_id, {sql_names(st.SURVIVAL_NAMES)} || '_' || session_id AS session_id, round("Timestamp", 6) AS "Timestamp", Arbitration_ID, DLC, {', '.join(BYTES)},
        {SURVIVAL_LABEL} AS attack_type FROM frames""",
)
def survival_text(spark, sf_dir):
    return shown(delimited.parse_survival(st.log_lines(spark, sf_dir, "survival_analysis")))


INJECTIONS = f"""spans AS (SELECT session_id, cap_no, min("Timestamp") AS t0, max("Timestamp") - min("Timestamp") AS span FROM frames GROUP BY 1, 2),
busy AS (SELECT session_id, Arbitration_ID AS busiest FROM (SELECT session_id, Arbitration_ID,
         row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, Arbitration_ID) AS r FROM frames GROUP BY 1, 2) WHERE r = 1),
injections AS (SELECT {road_stem('s.session_id', 's.cap_no')} AS stem, s.session_id, t0, round(span * 0.1::DOUBLE, 3) AS t_lo, round(span * 0.3::DOUBLE, 3) AS t_hi,
         '05XXXXXXXXXXXXXX' AS pattern, CASE WHEN s.cap_no % 2 = 0 THEN 'XXX' ELSE busiest END AS target FROM spans s JOIN busy USING (session_id))"""
ROAD = f"""{FRAMES}, {INJECTIONS},
road AS (SELECT f.*, i.stem, i.t_lo, i.t_hi, i.target, "Timestamp" - i.t0 AS rel, {PAYLOAD} AS raw, lpad({PAYLOAD}, 16, '0') AS p,
         ['CS','Fuzzing','MEC','MS','RLOn','RLOff',NULL][f.cap_no % 7 + 1] AS family,
         CAST('0x' || Arbitration_ID AS INTEGER) AS id_number FROM frames f JOIN injections i USING (session_id)),
road_rule AS (SELECT *, family IS NOT NULL AND round(rel, 6) BETWEEN t_lo AND t_hi AND (target = 'XXX' OR target = Arbitration_ID) AND substr(p, 1, 2) = '05' AS hit FROM road)"""


@query(
    "s11_road_candump",
    f"""WITH {ROAD} SELECT row_id, stem AS session_id, round(rel, 6) AS "Timestamp", Arbitration_ID, DLC, {SLICED},
        CASE WHEN hit THEN family ELSE 'Normal' END AS attack_type FROM road_rule WHERE id_number <= 1792 AND raw <> ''""",
)
def road_candump(spark, sf_dir):
    lines = st.log_lines(spark, sf_dir, "road_raw").unionByName(st.stray_text(spark, sf_dir, "road_raw"))
    return shown(candump.parse_road(lines, st.injections(spark, sf_dir)))


@query(
    "p09_injection_rule",
    f"""WITH {ROAD} SELECT stem AS session_id, count(*) AS frames, count(*) FILTER (hit) AS injected FROM road_rule WHERE id_number <= 1792 AND raw <> '' GROUP BY stem""",
)
def injection_rule(spark, sf_dir):
    frames = accepted(candump.parse_road(st.log_lines(spark, sf_dir, "road_raw"), st.injections(spark, sf_dir)))
    return frames.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("attack_type") != "Normal").alias("injected")
    )


@query(
    "j03_interval_join",
    f"""WITH {FRAMES}, {INJECTIONS} SELECT f.row_id, i.stem AS session_id FROM frames f JOIN injections i ON f.session_id = i.session_id
        AND round(f."Timestamp" - i.t0, 6) BETWEEN i.t_lo AND i.t_hi""",
)
def interval_join(spark, sf_dir):
    """Frames inside their capture's interval: an equi-join on the capture, then a bound."""
    layout = st.layout(spark, sf_dir)
    stem = discovery.file_stem(st.capture_path("road_raw", F.col("session_id")))
    frames = layout.frames.join(layout.sessions.select("session_id", "t_first"), "session_id").select(
        "row_id", stem.alias("session_id"), F.round(F.col("Timestamp") - F.col("t_first"), 6).alias("rel")
    )
    return (
        frames.join(st.injections(spark, sf_dir), "session_id")
        .where(F.col("rel").between(F.col("t_lo"), F.col("t_hi")))
        .select("row_id", "session_id")
    )


@query(
    "p10_in_scope_ids",
    f"""WITH {FRAMES} SELECT session_id, count(*) AS frames FROM frames WHERE CAST('0x' || Arbitration_ID AS INTEGER) <= 1792 GROUP BY session_id""",
)
def in_scope_ids(spark, sf_dir):
    return (
        st.frames(spark, sf_dir).where(id_value() <= candump.ROAD_SCOPE)
        .groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"))
    )


@query(
    "s12_mirgu_candump",
    f"""WITH {FRAMES}, m AS (SELECT *, lpad({PAYLOAD}, 16, '0') AS p, "Timestamp" - min("Timestamp") OVER (PARTITION BY session_id) AS rel FROM frames)
        SELECT row_id, {mirgu_stem()} AS session_id, round(rel, 6) AS "Timestamp", Arbitration_ID, DLC, {SLICED},
        CASE WHEN attack_type = 'Normal' THEN 'Normal' ELSE ['Normal','Masquerade','Suspension','Fuzzing','DoS','Replay','Spoofing'][cap_no % 7 + 1] END AS attack_type FROM m""",
)
def mirgu_candump(spark, sf_dir):
    return shown(candump.parse_mirgu(st.log_lines(spark, sf_dir, "can_mirgu")))


@query(
    "p06_labels_from_flags",
    f"""WITH {FRAMES} SELECT cap_no % 5 AS kind, CASE WHEN attack_type <> 'Normal' THEN ['DoS','Fuzzy','Gear','RPM','Normal'][cap_no % 5 + 1] ELSE 'Normal' END AS attack_type, count(*) AS rows
        FROM frames GROUP BY 1, 2""",
)
def labels_from_flags(spark, sf_dir):
    good = accepted(delimited.parse_hcrl(st.log_lines(spark, sf_dir, "hcrl_carhacking")))
    number = F.regexp_extract("session_id", "cap_([0-9]+)", 1).cast("int")
    return good.groupBy((number % 5).alias("kind"), "attack_type").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "p08_compound_relabel",
    f"""WITH {FRAMES}, r AS (SELECT *, ("Timestamp" - min("Timestamp") OVER (PARTITION BY session_id)) / 2000 AS rel FROM frames WHERE attack_type <> 'Normal')
        SELECT row_id, CASE cap_no % 4 WHEN 0 THEN CASE WHEN Arbitration_ID = '000' THEN 'DoS' ELSE 'Fuzzing' END
          WHEN 1 THEN CASE WHEN rel < 70 THEN 'Spoofing' ELSE 'Fuzzing' END WHEN 2 THEN CASE WHEN rel >= 880 THEN 'Fuzzing' ELSE 'Spoofing' END
          ELSE attack_type END AS attack_type FROM r""",
)
def compound_relabel(spark, sf_dir):
    """The three mixed captures, on attack frames with time compressed to their scale."""
    stems = ("fuzzing_valid_ids_dos", "reverse_speedometer_fuzzing_attack", "multiple_attacks_2", "single_attack")
    frames = st.frames(spark, sf_dir).where("attack_type <> 'Normal'")
    firsts = frames.groupBy("session_id").agg(F.min("Timestamp").alias("t0"))
    relative = (F.col("Timestamp") - F.col("t0")) / 2000
    return frames.join(firsts, "session_id").select(
        "row_id",
        labels.compound_family(
            st.named(F.col("session_id"), stems), F.col("attack_type"), F.col("Arbitration_ID"), relative
        ).alias("attack_type"),
    )


@query(
    "s03_frames_per_dialect",
    f"""WITH {FRAMES} SELECT dialect, CAST(CASE WHEN dialect = 'road_raw' THEN (SELECT count(*) FROM frames WHERE CAST('0x' || Arbitration_ID AS INTEGER) <= 1792 AND DLC > 0)
        ELSE (SELECT count(*) FROM frames) END AS BIGINT) AS frames
        FROM (VALUES ('car_hacking_attack_defense'), ('hcrl_carhacking'), ('road_raw'), ('can_mirgu'), ('ciciov2024'), ('survival_analysis')) AS d(dialect)""",
)
def frames_per_dialect(spark, sf_dir):
    counts, base = None, st.rendered(spark, sf_dir)
    for dialect in discovery.DIALECT_GLOBS:
        parse = captures.parser_for(dialect, st.injections(spark, sf_dir, base) if dialect == "road_raw" else None)
        one = accepted(parse(st.log_lines(spark, sf_dir, dialect, base))).agg(F.count(F.lit(1)).alias("frames"))
        one = one.select(F.lit(dialect).alias("dialect"), "frames")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query(
    "s13_injection_metadata",
    f"WITH {FRAMES}, {INJECTIONS} SELECT stem AS session_id, t_lo, t_hi, pattern, target FROM injections",
)
def injection_metadata(spark, sf_dir):
    """The sidecar file, one JSON object with an entry per capture, written and read back."""
    path = scratch_path(spark, "metadata")
    candump.write_injections(st.injections(spark, sf_dir), path)
    return candump.read_injections(spark, path, by_line=True)


def text_captures(spark, sf_dir):
    """The frames as labelled text files in one folder per capture, in frame order."""
    path = scratch_path(spark, "captures")
    lines = st.log_lines(spark, sf_dir, "hcrl_text").select("capture", "line_key", "value")
    (
        lines.repartitionByRange("capture", "line_key")
        .sortWithinPartitions("capture", "line_key")
        .select("capture", "value")
        .write.partitionBy("capture")
        .text(path)
    )
    return path


def capture_of(path):
    return F.regexp_extract(path, "capture=([^/]+)/", 1)


@query("s01_capture_files", f"WITH {FRAMES} SELECT session_id AS capture, count(*) AS lines FROM frames GROUP BY 1")
def capture_files(spark, sf_dir):
    lines = discovery.read_lines(spark, text_captures(spark, sf_dir), "hcrl_carhacking")
    return lines.groupBy(capture_of(F.col("path")).alias("capture")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "s14_row_ids_over_files",
    f"""WITH {FRAMES} SELECT row_number() OVER (ORDER BY session_id, row_id) - 1 AS row_id, session_id AS capture, round("Timestamp", 6) AS "Timestamp", Arbitration_ID FROM frames""",
)
def row_ids_over_files(spark, sf_dir):
    lines = discovery.read_lines(spark, text_captures(spark, sf_dir), "hcrl_carhacking")
    parsed = accepted(staged(delimited.parse_hcrl(lines))).withColumn("session_id", capture_of(F.col("path")))
    return captures.with_row_ids(parsed).select(
        "row_id", F.col("session_id").alias("capture"), F.round("Timestamp", 6).alias("Timestamp"), "Arbitration_ID"
    )


STRAYS = f"""strays AS (SELECT 'cap_' || (doc_id % 15) || CASE WHEN doc_id % 2 = 0 THEN '_D' ELSE '_S' END AS capture, doc_id % 15 AS n FROM documents
  WHERE trim(translate(text, chr(10) || chr(13) || ',', '   ')) <> '')"""


@query(
    "s15_rejected_lines",
    f"""WITH {ROAD}, {STRAYS} SELECT {road_stem('capture', 'n')} AS session_id, 'malformed' AS reject_reason, count(*) AS lines FROM strays GROUP BY 1
        UNION ALL SELECT stem, CASE WHEN id_number > 1792 THEN 'out_of_scope' ELSE 'bad_payload' END, count(*) FROM road WHERE id_number > 1792 OR raw = '' GROUP BY 1, 2""",
)
def rejected_lines(spark, sf_dir):
    lines = st.log_lines(spark, sf_dir, "road_raw").unionByName(st.stray_text(spark, sf_dir, "road_raw"))
    return reject_counts(candump.parse_road(lines, st.injections(spark, sf_dir)))


LONG = "row_id % 50 = 7"


def lengthened(lines, more):
    """Every fiftieth line of a capture with a ninth byte or a thirteenth cell."""
    return lines.withColumn("value", F.when(F.expr(LONG.replace("row_id", "line_key")), F.concat("value", more)).otherwise(F.col("value")))


@query(
    "s15_overlong_lines",
    f"""WITH {FRAMES} SELECT dialect, CASE WHEN dialect = 'hcrl_csv' THEN 'too_many_cells' ELSE 'too_many_bytes' END AS reject_reason,
        count(*) FILTER ({LONG}) AS lines, count(*) FILTER (NOT {LONG}) AS frames
        FROM frames, (VALUES ('hcrl_csv'), ('hcrl_text'), ('survival_analysis'), ('car_hacking_attack_defense')) AS d(dialect) GROUP BY 1, 2""",
)
def overlong_lines(spark, sf_dir):
    """Lines with more bytes or cells than a frame has are rejected and counted, not cut."""
    nine = F.lit(" ".join(["AA"] * 9))
    texts = {
        "hcrl_csv": (delimited.parse_hcrl, "hcrl_carhacking", F.lit("," * 12 + "R")),
        "hcrl_text": (delimited.parse_hcrl_text, "hcrl_text", F.concat(F.lit(" "), nine)),
        "survival_analysis": (delimited.parse_survival, "survival_analysis", F.lit("," * 9 + "AA,R")),
        "car_hacking_attack_defense": (delimited.parse_attack_defense, "car_hacking_attack_defense", None),
    }
    counts = None
    for name, (parse, dialect, more) in texts.items():
        lines = st.log_lines(spark, sf_dir, dialect)
        if more is None:  # the payload is the fourth cell
            cells = F.split("value", ",")
            payload = F.concat_ws(",", F.slice(cells, 1, 3), nine, F.slice(cells, 5, F.size(cells)))
            lines = lines.withColumn("value", F.when(F.col("line_key") % 50 == 7, payload).otherwise(F.col("value")))
        else:
            lines = lengthened(lines, more)
        parsed = parse(lines).agg(
            F.max("reject_reason").alias("reject_reason"), F.count("reject_reason").alias("lines"),
            F.count_if(F.col("reject_reason").isNull()).alias("frames"),
        )
        one = parsed.select(F.lit(name).alias("dialect"), "reject_reason", "lines", "frames")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query(
    "s15_captures_without_frames",
    f"""WITH {STRAYS} SELECT DISTINCT {mirgu_stem('capture', 'n')} AS session_id FROM strays""",
)
def empty_captures(spark, sf_dir):
    """Captures made of text only: no line parses."""
    return captures_without_frames(candump.parse_mirgu(st.stray_text(spark, sf_dir, "can_mirgu")))


@query(
    "s16_frame_table_round_trip",
    f"WITH {FRAMES} SELECT session_id, count(*) AS frames, min(row_id) AS first_row, max(row_id) AS last_row, min(Data_3) AS low FROM frames GROUP BY session_id",
)
def frame_table_round_trip(spark, sf_dir):
    path = scratch_path(spark, "canonical")
    tables.write_frames(st.frames(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("frames"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"),
        F.min("Data_3").alias("low"),
    )


@query(
    "s17_split_tables_with_empty_split",
    f"""WITH {FRAMES} SELECT s AS split, count(row_id) AS rows FROM (VALUES ('train'), ('val'), ('test')) AS x(s)
        LEFT JOIN (SELECT row_id, CASE WHEN session_id IN {sql_list(st.VAL_SESSIONS)} THEN 'val' ELSE 'train' END AS split FROM frames) ON split = s GROUP BY s""",
)
def split_tables_with_empty_split(spark, sf_dir):
    path = scratch_path(spark, "splits")
    table = splits.holdout_frames(st.frames(spark, sf_dir), st.VAL_SESSIONS, [])
    tables.write_splits(table, path)
    parts = [
        tables.read_split(spark, path, name, table.schema).agg(F.count("row_id").alias("rows")).select(F.lit(name).alias("split"), "rows")
        for name in splits.SPLITS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s18_column_subset", f"WITH {LABELLED} SELECT row_id, Arbitration_ID, \"Class\" FROM labelled")
def column_subset(spark, sf_dir):
    wanted = ["row_id", "Arbitration_ID", "Class", "Deltatime"]
    return tables.read_frames(spark, f"{st.layout(spark, sf_dir).path}/rows", wanted)


@query("s19_row_count", "SELECT count(*) AS rows FROM events")
def row_count(spark, sf_dir):
    return tables.count_rows(spark, f"{sf_dir}/events.parquet")


@query(
    "s20_json_report",
    f"""WITH {LABELLED} SELECT "Class", count(*) AS rows, round(count(*) / sum(count(*)) OVER ()::DOUBLE * 100, 4) AS percentage FROM labelled GROUP BY "Class" """,
)
def json_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    report = audits.class_distribution(st.labelled(spark, sf_dir), "Class")
    tables.write_report(report, path)
    schema = T.StructType([T.StructField("Class", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("percentage", T.DoubleType())])
    return spark.read.schema(schema).json(path)
