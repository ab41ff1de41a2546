"""Byte behaviour, attack segments, swarm layout and raw-file audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from canlake.operators import audits, deltas, sampling, traffic
from canlake.plans import standin as st
from canlake.plans.catalog.registry import query
from canlake.plans.catalog.twins import BYTES, FRAMES, PREPARED, number
from canlake.streaming.busload import tumbling_load

PATTERNS = f"""WITH {PREPARED},
long AS ({" UNION ALL ".join(f"SELECT Arbitration_ID, DLC, session_id, pos, {i} AS byte, {number(b)} AS v FROM prepared" for i, b in enumerate(BYTES))}),
caps AS (SELECT Arbitration_ID, max(DLC) AS dlc FROM prepared GROUP BY Arbitration_ID),
steps AS (SELECT *, v - lag(v) OVER (PARTITION BY Arbitration_ID, byte ORDER BY session_id, pos) AS d FROM long WHERE v IS NOT NULL),
sums AS (SELECT Arbitration_ID, byte, count(*) AS n, count(DISTINCT v) AS u, count(d) AS nd,
         count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down FROM steps GROUP BY 1, 2)
SELECT c.Arbitration_ID, CAST(b.byte AS INTEGER) AS byte,
       CASE WHEN b.byte >= c.dlc OR s.n IS NULL THEN 'No byte' WHEN s.u = 1 OR s.nd = 0 THEN 'Constant'
            WHEN greatest(s.up, s.down) / s.nd::DOUBLE > 0.75::DOUBLE AND s.u > 8 THEN 'Sawtooth'
            WHEN s.u <= 8 THEN 'Random' ELSE 'Polynomial' END AS pattern
FROM caps c CROSS JOIN range(0, 8) AS b(byte) LEFT JOIN sums s ON s.Arbitration_ID = c.Arbitration_ID AND s.byte = b.byte"""


@query("a14_byte_patterns", PATTERNS)
def byte_patterns(spark, sf_dir):
    return traffic.byte_patterns(st.positioned(spark, sf_dir))


@query(
    "w12_attack_segments",
    f"""WITH {PREPARED}, runs AS (SELECT *, pos - row_number() OVER (PARTITION BY session_id, "Class" ORDER BY pos) AS island FROM prepared),
        spans AS (SELECT session_id, "Class", min(pos) AS first_pos, count(*) AS frames,
                  (min("Timestamp") - any_value(t_first)) * 1000 AS a, (max("Timestamp") - any_value(t_first)) * 1000 AS b
                  FROM runs GROUP BY session_id, "Class", island)
        SELECT session_id, "Class", first_pos, frames, round(a, 3) AS start_ms, round(CASE WHEN a = b THEN a + 0.01::DOUBLE ELSE b END, 3) AS end_ms FROM spans""",
)
def attack_segments(spark, sf_dir):
    layout = st.layout(spark, sf_dir)
    found = traffic.attack_segments(layout.frames, layout.sessions)
    return found.select(
        "session_id", "Class", "first_pos", "frames", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms")
    )


@query(
    "f19_swarm_offsets",
    f"""WITH {PREPARED}, capped AS (SELECT row_id, Arbitration_ID, "Class", Delta_Id * 1000 AS gap_ms FROM (
          SELECT *, row_number() OVER (PARTITION BY Arbitration_ID, "Class" ORDER BY md5('42:' || row_id), row_id) AS r FROM prepared) WHERE r <= 4000),
        lows AS (SELECT *, min(gap_ms) OVER g AS lo, max(gap_ms) OVER g AS hi FROM capped WINDOW g AS (PARTITION BY Arbitration_ID, "Class")),
        bins AS (SELECT *, CAST(CASE WHEN hi = lo THEN 0 ELSE least(greatest(floor((gap_ms - lo) / (hi - lo) * 100), 0), 99) END AS INTEGER) AS bin FROM lows),
        places AS (SELECT *, count(*) OVER (PARTITION BY Arbitration_ID, "Class", bin) AS c,
                   row_number() OVER (PARTITION BY Arbitration_ID, "Class", bin ORDER BY row_id) - 1 AS r FROM bins)
        SELECT row_id, bin, round(CASE WHEN c = 1 THEN 0.0::DOUBLE ELSE least(greatest((r - (c - 1) / 2::DOUBLE) * least(0.055::DOUBLE, 0.42::DOUBLE / greatest(1.0::DOUBLE, (c - 1) / 2::DOUBLE)), -0.42::DOUBLE), 0.42::DOUBLE) END, 9) + 0.0::DOUBLE AS "offset" FROM places""",
)
def swarm_offsets(spark, sf_dir):
    frames = deltas.with_delta_id(st.positioned(spark, sf_dir)).select(
        "row_id", "Arbitration_ID", "Class", (F.col("Delta_Id") * 1000).alias("gap_ms")
    )
    groups = ["Arbitration_ID", "Class"]
    points = sampling.capped_sample(frames, groups, "row_id", 4000)
    found = traffic.swarm_offsets(points, groups, "gap_ms", "row_id")
    return found.select("row_id", "bin", (F.round("offset", 9) + 0.0).alias("offset"))


@query(
    "a08_raw_capture_audit",
    f"""WITH {FRAMES} SELECT '/captures/' || session_id || '.csv' AS file, cap_no % 3 <> 0 AS has_subclass,
        CASE WHEN cap_no % 3 <> 0 THEN attack_type WHEN attack_type = 'Normal' THEN 'Normal' ELSE 'Attack' END AS source_label,
        count(*) AS rows, min("Timestamp") AS t_min, max("Timestamp") AS t_max FROM frames GROUP BY 1, 2, 3""",
)
def raw_capture_audit(spark, sf_dir):
    from canlake.sources.parsing import cell, has_column, with_header

    wanted = ["Timestamp", "SubClass", "Class"]
    lines = with_header(st.log_lines(spark, sf_dir, "car_hacking_attack_defense"), wanted, "Arbitration_ID")
    sub = has_column("SubClass")
    return audits.capture_audit(
        lines.select(
            F.col("path").alias("file"),
            sub.alias("has_subclass"),
            F.when(sub, cell("SubClass")).otherwise(cell("Class")).alias("source_label"),
            cell("Timestamp").cast("double").alias("Timestamp"),
        )
    )


@query(
    "r03_tumbling_bus_load",
    f"""WITH {FRAMES}, binned AS (SELECT session_id, Arbitration_ID, CAST(floor(round("Timestamp" * 1e6::DOUBLE) / 20000) * 20000 AS BIGINT) AS start_us FROM frames)
        SELECT session_id, start_us, count(*) AS frames, CAST(count(DISTINCT Arbitration_ID) AS INTEGER) AS ids FROM binned GROUP BY 1, 2""",
)
def tumbling_bus_load(spark, sf_dir):
    return tumbling_load(st.frames(spark, sf_dir))
