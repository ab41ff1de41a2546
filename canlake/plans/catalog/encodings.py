"""Identifier, payload and time encodings of frames and windows.

Arrays are shown as text so that both engines print the same value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canlake.functions import encodings as enc
from canlake.functions import hexfields as hx
from canlake.operators import windows as win
from canlake.plans import standin as st
from canlake.plans.catalog.registry import query
from canlake.plans.catalog.twins import BYTES, FRAMES, LABELLED, members, number, zero
from canlake.schemas import BYTE_COLUMNS


def shown(array, sep=" "):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


def micro(array):
    """Doubles as whole millionths, joined."""
    return F.array_join(F.transform(array, lambda x: F.round(x * 1e6).cast("long").cast("string")), " ")


def decoded_frames(spark, sf_dir):
    return hx.decoded(st.frames(spark, sf_dir))


ID_INT = "CAST('0x' || Arbitration_ID AS INTEGER)"
JOIN8 = "concat_ws(' ', {})"


def per_byte(template: str) -> str:
    return ", ".join(template.format(b) for b in BYTES)


@query(
    "p01_canonical_ids",
    f"""WITH {FRAMES} SELECT row_id, Arbitration_ID AS canonical,
        lpad(ltrim(Arbitration_ID || 'F', '0'), CAST(greatest(3, length(ltrim(Arbitration_ID || 'F', '0'))) AS INTEGER), '0') AS longer_kept FROM frames""",
)
def canonical_ids(spark, sf_dir):
    written = F.concat(F.lit("  0x000"), F.lower("Arbitration_ID"), F.lit(" "))
    longer = F.concat(F.lit("0X"), F.col("Arbitration_ID"), F.lit("f"))
    return st.frames(spark, sf_dir).select(
        "row_id", hx.canonical_id(written).alias("canonical"), hx.canonical_id(longer).alias("longer_kept")
    )


@query(
    "p02_id_range",
    f"""WITH {FRAMES} SELECT row_id, CAST('0x' || Arbitration_ID AS INTEGER) * 2 <= 2047 AS eleven_bit,
        true AS road_limit, CAST('0x' || Arbitration_ID AS INTEGER) <= 1792 AS road_scope FROM frames""",
)
def id_range(spark, sf_dir):
    doubled = F.hex(enc.id_value().cast("long") * 2)
    return st.frames(spark, sf_dir).select(
        "row_id",
        hx.id_in_range(doubled, 0x7FF).alias("eleven_bit"),
        hx.id_in_range("Arbitration_ID", 0xFFF).alias("road_limit"),
        hx.id_in_range("Arbitration_ID", 0x700).alias("road_scope"),
    )


@query(
    "p03_normal_bytes",
    f"""WITH {FRAMES} SELECT row_id, Data_3 AS two_digits, CASE WHEN Data_3 = 'PAD' THEN 'PAD' ELSE lpad(right(Data_3, 1), 2, '0') END AS one_digit,
        'PAD' AS flag_text, CAST(NULL AS VARCHAR) AS too_big FROM frames""",
)
def normal_bytes(spark, sf_dir):
    text = F.col("Data_3")
    return st.frames(spark, sf_dir).select(
        "row_id",
        hx.normal_byte(F.concat(F.lit(" "), F.lower(text))).alias("two_digits"),
        hx.normal_byte(F.when(text == "PAD", "").otherwise(F.concat(F.lit("0x"), F.right(text, F.lit(1))))).alias("one_digit"),
        hx.normal_byte(F.when(F.col("row_id") % 2 == 0, "R").otherwise(" t")).alias("flag_text"),
        hx.normal_byte(F.concat(F.lit("1"), F.lit("FF"))).alias("too_big"),
    )


@query(
    "p04_payload_slices",
    f"""WITH {FRAMES}, padded AS (SELECT row_id, lpad({"||".join(f"CASE WHEN {b} = 'PAD' THEN '' ELSE {b} END" for b in BYTES)}, 16, '0') AS p FROM frames)
        SELECT row_id, {", ".join(f"substr(p, {2 * i + 1}, 2) AS Data_{i}" for i in range(8))} FROM padded""",
)
def payload_slices(spark, sf_dir):
    payload = F.lpad(st.present_bytes(""), 16, "0")
    return st.frames(spark, sf_dir).select("row_id", *hx.bytes_of_payload(payload))


@query("p05_spaced_payload", f"WITH {FRAMES} SELECT row_id, {', '.join(BYTES)} FROM frames")
def spaced_payload(spark, sf_dir):
    spaced = st.present_bytes(" ")
    parts = F.split(F.when(spaced != "", spaced), " ")
    return st.frames(spark, sf_dir).select("row_id", *hx.bytes_of_list(parts))


@query(
    "f01_hex_values",
    f"""WITH {FRAMES} SELECT row_id, {ID_INT} AS id_number, {", ".join(f"{zero(b)} AS z{i}, {number(b)} AS n{i}" for i, b in enumerate(BYTES))} FROM frames""",
)
def hex_values(spark, sf_dir):
    columns = []
    for i, name in enumerate(BYTE_COLUMNS):
        columns += [hx.byte_or_zero(name).alias(f"z{i}"), hx.byte_value(name).alias(f"n{i}")]
    return st.frames(spark, sf_dir).select("row_id", enc.id_value().alias("id_number"), *columns)


@query(
    "f02_id_bits",
    f"""WITH {FRAMES} SELECT row_id, lpad(bin({ID_INT}), 11, '0') AS bits FROM frames""",
)
def id_bits(spark, sf_dir):
    return decoded_frames(spark, sf_dir).select("row_id", shown(enc.id_bits(), "").alias("bits"))


VECTOR_SQL = (
    f"concat_ws(' ', array_to_string(string_split(lpad(bin({ID_INT}), 11, '0'), ''), ' '), DLC, "
    + per_byte("COALESCE(CASE WHEN {0} <> 'PAD' THEN CAST('0x' || {0} AS INTEGER) END, 0)")
    + ")"
)


@query("f03_frame_vectors", f"WITH {FRAMES} SELECT row_id, {VECTOR_SQL} AS vector FROM frames")
def frame_vectors(spark, sf_dir):
    return decoded_frames(spark, sf_dir).select(
        "row_id", shown(F.transform(enc.frame_vector(), lambda x: x.cast("int"))).alias("vector")
    )


@query(
    "f06_id_nibbles_and_bytes",
    f"""WITH {FRAMES} SELECT row_id, concat_ws(' ', {", ".join(f"CAST('0x' || substr(lpad(Arbitration_ID, 4, '0'), {i + 1}, 1) AS INTEGER)" for i in range(4))},
        {per_byte("COALESCE(CASE WHEN {0} <> 'PAD' THEN CAST('0x' || {0} AS INTEGER) END, 0)")}) AS features FROM frames""",
)
def id_nibbles_and_bytes(spark, sf_dir):
    return decoded_frames(spark, sf_dir).select("row_id", shown(enc.id_nibbles_and_bytes()).alias("features"))


HEX_DIGITS = (
    "Arbitration_ID || " + " || ".join(f"CASE WHEN {b} = 'PAD' THEN '00' ELSE {b} END" for b in BYTES)
)


@query(
    "f07_nibble_tokens",
    f"""WITH {FRAMES} SELECT row_id, array_to_string([CAST('0x' || c AS INTEGER) for c in string_split({HEX_DIGITS}, '')], ' ') AS tokens FROM frames""",
)
def nibble_tokens(spark, sf_dir):
    return decoded_frames(spark, sf_dir).select("row_id", shown(enc.nibble_tokens()).alias("tokens"))


@query(
    "f08_payload_bits",
    f"""WITH {FRAMES} SELECT row_id, concat_ws('/', {", ".join(f"lpad(bin({zero(b)}), 8, '0')" for b in BYTES)}) AS bits FROM frames""",
)
def payload_bits(spark, sf_dir):
    rows = F.transform(enc.payload_bits(), lambda r: F.array_join(F.transform(r, lambda b: b.cast("string")), ""))
    return decoded_frames(spark, sf_dir).select("row_id", F.array_join(rows, "/").alias("bits"))


@query(
    "f09_nibbles_of_bits",
    f"""WITH {FRAMES} SELECT row_id, array_to_string([CAST('0x' || c AS INTEGER) for c in string_split({" || ".join(f"CASE WHEN {b} = 'PAD' THEN '00' ELSE {b} END" for b in BYTES)}, '')], ' ') AS nibbles FROM frames""",
)
def nibbles_of_bits(spark, sf_dir):
    matrices = decoded_frames(spark, sf_dir).select("row_id", enc.payload_bits().alias("matrix"))
    return matrices.select("row_id", shown(enc.nibbles_of_bits("matrix")).alias("nibbles"))


def _token(b: str) -> str:
    return f"CASE WHEN {b} = 'PAD' THEN 2304 ELSE CAST('0x' || {b} AS INTEGER) END"


@query(
    "f10_token_ids",
    f"WITH {FRAMES} SELECT row_id, {ID_INT} + 256 AS id_token, concat_ws(' ', {', '.join(_token(b) for b in BYTES)}) AS payload FROM frames",
)
def token_ids(spark, sf_dir):
    return st.frames(spark, sf_dir).select(
        "row_id", enc.id_token().alias("id_token"), shown(enc.payload_tokens()).alias("payload")
    )


@query(
    "f11_masked_sequences",
    f"""WITH {members()} SELECT session_id, start_row_id,
        array_to_string(list_append(list_slice(list({ID_INT} + 256 ORDER BY offs), 1, 15), 2305), ' ') AS temporal,
        max(CASE WHEN offs = 15 THEN concat_ws(' ', {', '.join(_token(b) for b in BYTES)}) END) AS spatial,
        max(CASE WHEN offs = 15 THEN {ID_INT} + 256 END) AS target,
        CAST(max(CASE WHEN offs = 15 THEN CASE WHEN "Class" > 0 THEN 1 ELSE 0 END END) AS INTEGER) AS attack
        FROM members GROUP BY session_id, start_row_id""",
)
def masked_sequences(spark, sf_dir):
    found = win.masked_sequences(st.positioned(spark, sf_dir), st.WINDOW, st.STRIDE, st.FIVE)
    return found.withColumn("temporal", shown("temporal")).withColumn("spatial", shown("spatial"))


@query(
    "f05_flattened_windows",
    f"""WITH {members()} SELECT session_id, start_row_id,
        CAST(max(CASE WHEN offs = 15 THEN "Class" END) AS BIGINT) AS label,
        string_agg({VECTOR_SQL}, ' ' ORDER BY offs) AS vector FROM members GROUP BY session_id, start_row_id""",
)
def flattened_windows(spark, sf_dir):
    found = win.flattened_vectors(st.positioned(spark, sf_dir), st.WINDOW, st.STRIDE)
    return found.withColumn("vector", shown(F.transform("vector", lambda x: x.cast("int"))))


@query(
    "f12_frame_text",
    f"WITH {FRAMES} SELECT row_id, concat_ws(' ', Arbitration_ID, DLC::VARCHAR, {', '.join(BYTES)}) AS text FROM frames",
)
def frame_text(spark, sf_dir):
    return st.frames(spark, sf_dir).select("row_id", enc.frame_text().alias("text"))


TIME_WIDTH = 10


def _waves(base: str, width: int) -> str:
    parts = []
    for i in range(0, width, 2):
        scale = repr(float(10000.0 ** (i / width)))
        parts += [f"round(sin({base} / {scale}::DOUBLE), 6) + 0.0::DOUBLE AS e{i}", f"round(cos({base} / {scale}::DOUBLE), 6) + 0.0::DOUBLE AS e{i + 1}"]
    return ", ".join(parts)


def wave_columns():
    return [(F.round(F.get("encoding", F.lit(i)), 6) + 0.0).alias(f"e{i}") for i in range(TIME_WIDTH)]


@query(
    "f13_window_time_encoding",
    f"""WITH {members()}, elapsed AS (
          SELECT session_id, start_row_id, offs, "Timestamp" - min("Timestamp") OVER (PARTITION BY session_id, start_row_id) AS dt FROM members),
        places AS (SELECT *, CASE WHEN offs = 0 THEN 0.0::DOUBLE ELSE offs + log2(greatest(dt / 1e-7::DOUBLE, 0.0::DOUBLE) + 1.0::DOUBLE) END AS p FROM elapsed)
        SELECT session_id, start_row_id, CAST(offs AS INTEGER) AS "offset", {_waves('p', TIME_WIDTH)} FROM places""",
)
def window_time_encoding(spark, sf_dir):
    found = win.time_encoded_windows(st.positioned(spark, sf_dir), st.WINDOW, st.STRIDE, TIME_WIDTH)
    return found.select("session_id", "start_row_id", "offset", *wave_columns())


@query(
    "f14_absolute_time_encoding",
    f"""WITH {FRAMES}, ticks AS (SELECT row_id, CAST(least(greatest(round_even(log2(greatest(round_even("Timestamp" / 1e-8::DOUBLE, 0) + 1.0::DOUBLE, 1.0::DOUBLE)), 0), 0), 9999) AS INTEGER) AS i FROM frames)
        SELECT row_id, i AS time_index, {_waves('i', TIME_WIDTH)} FROM ticks""",
)
def absolute_time_encoding(spark, sf_dir):
    placed = st.frames(spark, sf_dir).select("row_id", enc.absolute_time_index().alias("time_index"))
    return placed.withColumn("encoding", enc.sinusoids(F.col("time_index"), TIME_WIDTH)).select(
        "row_id", "time_index", *wave_columns()
    )


@query(
    "f16_list_functions",
    f"""WITH {LABELLED}, groups AS (SELECT session_id, list("Class" ORDER BY "Timestamp", row_id) AS labels FROM labelled WHERE "Class" <> 0 GROUP BY session_id)
        SELECT session_id, array_to_string(list_sort(list_distinct(labels)), ' ') AS distinct_labels, len([x for x in labels if x > 2]) AS above_two
        FROM groups""",
)
def list_functions(spark, sf_dir):
    base = st.labelled(spark, sf_dir).where("Class <> 0").groupBy("session_id", "Class").agg(F.count(F.lit(1)).alias("n"))
    return base.groupBy("session_id").agg(
        shown(F.array_sort(F.array_distinct(F.collect_list("Class")))).alias("distinct_labels"),
        F.sum(F.when(F.col("Class") > 2, F.col("n")).otherwise(0)).alias("above_two"),
    )


@query(
    "f16_list_functions_of_bytes",
    f"""WITH {FRAMES}, lists AS (SELECT row_id, [{', '.join(BYTES)}] AS bytes FROM frames),
        present AS (SELECT row_id, bytes, [x for x in bytes if x <> 'PAD'] AS filled, [CASE WHEN x <> 'PAD' THEN x END for x in bytes] AS gaps FROM lists)
        SELECT row_id, CAST(len(filled) AS INTEGER) AS n_filled, filled[-1] AS last_filled, array_to_string([x for x in gaps if x IS NOT NULL], '') AS payload,
               CAST(len(list_distinct(filled)) AS INTEGER) AS n_distinct, array_to_string(list_concat(list_slice(filled, 1, 2), list_slice(bytes, 7, 8)), ' ') AS ends FROM present""",
)
def list_functions_of_bytes(spark, sf_dir):
    """Filter, last, drop nulls, distinct and concatenation of the byte lists of all frames."""
    listed = st.frames(spark, sf_dir).select("row_id", F.array(*BYTES).alias("bytes"))
    filled = listed.withColumn("filled", F.filter("bytes", lambda x: x != "PAD"))
    gaps = F.transform("bytes", lambda x: F.when(x != "PAD", x))
    return filled.select(
        "row_id", F.size("filled").alias("n_filled"), F.try_element_at("filled", F.lit(-1)).alias("last_filled"),
        F.array_join(F.array_compact(gaps), "").alias("payload"), F.size(F.array_distinct("filled")).alias("n_distinct"),
        F.array_join(F.concat(F.slice("filled", 1, 2), F.slice("bytes", 7, 2)), " ").alias("ends"),
    )


@query(
    "f17_string_functions",
    f"""WITH {FRAMES} SELECT row_id, lpad(ltrim(Arbitration_ID, '0'), CAST(greatest(3, length(ltrim(Arbitration_ID, '0'))) AS INTEGER), '0') AS refilled,
        regexp_matches(session_id, '_S(_|$)') AS stationary, length(session_id) AS name_length,
        printf('%03X', {ID_INT}) AS formatted FROM frames""",
)
def string_functions(spark, sf_dir):
    return st.frames(spark, sf_dir).select(
        "row_id",
        hx.pad_left(F.ltrim(F.col("Arbitration_ID"), F.lit("0")), 3).alias("refilled"),
        F.col("session_id").rlike(r"_S(?:_|$)").alias("stationary"),
        F.length("session_id").cast("long").alias("name_length"),
        F.format_string("%03X", enc.id_value()).alias("formatted"),
    )


@query(
    "f18_display_scales",
    f"""WITH {FRAMES} SELECT row_id, round(("Timestamp" - min("Timestamp") OVER (PARTITION BY session_id)) * 1000.0::DOUBLE, 3) AS elapsed_ms,
        round(3 + ({number('Data_3')}) / 255.0::DOUBLE, 9) AS lane_3 FROM frames""",
)
def display_scales(spark, sf_dir):
    layout = st.layout(spark, sf_dir)
    return hx.decoded(layout.frames).join(layout.sessions.select("session_id", "t_first"), "session_id").select(
        "row_id",
        F.round(enc.elapsed_ms(F.col("Timestamp"), F.col("t_first")), 3).alias("elapsed_ms"),
        F.round(enc.byte_lane(3), 9).alias("lane_3"),
    )
