"""Windows, splits, samples and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from canlake.operators import audits, normalise, ordering, sampling, splits, windows as win
from canlake.plans import standin as st
from canlake.plans.catalog.encodings import shown
from canlake.plans.catalog.registry import query
from canlake.plans.catalog.twins import (
    BYTES, FRAMES, LABELLED, PREPARED, members, permutation, permuted, split_case, sql_list, windows, zero,
)
from canlake.schemas import label_schema
from canlake.storage import settle

SIZE, STRIDE = st.WINDOW, st.STRIDE


def candidates(spark, sf_dir):
    return win.candidate_windows(st.positioned(spark, sf_dir), SIZE, STRIDE, st.FIVE)


@query("w08_first_attack_windows", f"WITH {windows()} SELECT * FROM candidates")
def first_attack_windows(spark, sf_dir):
    return candidates(spark, sf_dir).select("session_id", "start_row_id", "start_pos", "label")


@query(
    "w08_window_label_distribution",
    f"""WITH {windows()} SELECT label, count(*) AS rows, round(count(*) / sum(count(*)) OVER ()::DOUBLE * 100, 4) AS percentage
        FROM candidates GROUP BY label""",
)
def window_label_distribution(spark, sf_dir):
    return audits.class_distribution(candidates(spark, sf_dir), "label")


@query("w09_last_frame_windows", f"WITH {windows()} SELECT * FROM lasts")
def last_frame_windows(spark, sf_dir):
    return win.last_frame_windows(st.positioned(spark, sf_dir), SIZE, STRIDE).select(
        "session_id", "start_row_id", "start_pos", "label"
    )


@query(
    "w10_loader_labels",
    f"""WITH {windows()} SELECT c.session_id || ':' || c.start_row_id AS window_id, c.label AS any_attack, l.label AS last_frame
        FROM candidates c JOIN lasts l USING (session_id, start_row_id)""",
)
def loader_labels(spark, sf_dir):
    frames = st.positioned(spark, sf_dir)
    index = win.window_references(candidates(spark, sf_dir), SIZE, positions=True)
    kept = win.relabel(index, frames, "any_attack").select("window_id", F.col("label").alias("any_attack"))
    last = win.relabel(index, frames, "last_frame").select("window_id", F.col("label").alias("last_frame"))
    return kept.join(last, "window_id")


@query(
    "d06_window_references",
    f"""WITH {windows()} SELECT session_id || ':' || start_row_id AS window_id, session_id, start_row_id,
        CAST({SIZE} AS BIGINT) AS window_size, label FROM candidates""",
)
def window_references(spark, sf_dir):
    return win.window_references(candidates(spark, sf_dir), SIZE)


@query(
    "j02_materialised_windows",
    f"""WITH {members()} SELECT session_id || ':' || start_row_id AS window_id,
        string_agg(row_id::VARCHAR, ' ' ORDER BY offs) AS rows, string_agg("Class"::VARCHAR, ' ' ORDER BY offs) AS classes,
        string_agg(Arbitration_ID, ' ' ORDER BY offs) AS ids FROM members GROUP BY session_id, start_row_id""",
)
def materialised_windows(spark, sf_dir):
    frames = st.positioned(spark, sf_dir)
    index = win.window_references(candidates(spark, sf_dir), SIZE)
    gathered = win.materialise(
        index, frames, SIZE, STRIDE, {"rows": F.col("row_id"), "classes": F.col("Class"), "ids": F.col("Arbitration_ID")}
    )
    return gathered.select("window_id", shown("rows").alias("rows"), shown("classes").alias("classes"), shown("ids").alias("ids"))


@query(
    "j02_incomplete_windows",
    f"""WITH {PREPARED}, refs AS (SELECT session_id || ':' || row_id AS window_id, session_id, pos, n_frames FROM prepared WHERE pos % 100 = 0)
        SELECT window_id, CAST(n_frames - pos AS BIGINT) AS found FROM refs WHERE pos + {SIZE} > n_frames""",
)
def incomplete_windows(spark, sf_dir):
    """References every 100 frames, the last of a session possibly too short."""
    frames = st.positioned(spark, sf_dir)
    starts = frames.where(F.col("pos") % 100 == 0).select(
        "session_id", F.col("row_id").alias("start_row_id"), F.lit(0).cast("long").alias("label")
    )
    index = win.window_references(starts, SIZE)
    return win.incomplete_windows(index, frames).select("window_id", "found")


@query(
    "j06_unknown_sessions",
    f"""WITH {windows()} SELECT DISTINCT 'ghost_' || session_id AS session_id FROM candidates WHERE label = 4""",
)
def unknown_sessions(spark, sf_dir):
    """A reference check that finds the renamed sessions of the replay windows."""
    index = candidates(spark, sf_dir).withColumn(
        "session_id", F.when(F.col("label") == 4, F.concat(F.lit("ghost_"), "session_id")).otherwise(F.col("session_id"))
    )
    return win.unknown_sessions(index, st.frames(spark, sf_dir))


@query(
    "j04_frames_of_sessions",
    f"WITH {FRAMES} SELECT row_id, session_id FROM frames WHERE session_id IN {sql_list(st.VAL_SESSIONS)}",
)
def frames_of_sessions(spark, sf_dir):
    frames = st.frames(spark, sf_dir)
    wanted = frames.select("session_id").where(F.col("session_id").isin(st.VAL_SESSIONS)).distinct()
    return splits.sessions_subset(frames, wanted).select("row_id", "session_id")


@query(
    "a13_window_norm_stats",
    f"WITH {members()} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({v}), 6) AS mean,
        round(CASE WHEN sqrt(greatest(avg({v} * {v}) - avg({v}) * avg({v}), 0)) < 1e-8 THEN 1.0 ELSE sqrt(greatest(avg({v} * {v}) - avg({v}) * avg({v}), 0)) END, 6) AS std FROM members"""
        for c, v in [("DLC", "DLC::DOUBLE"), *[(b, f"({zero(b)})::DOUBLE") for b in BYTES]]
    ),
)
def window_norm_stats(spark, sf_dir):
    layout = st.layout(spark, sf_dir)
    found = normalise.window_stats(layout.frames, layout.sessions, SIZE, STRIDE)
    return found.select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


PERMUTED = LABELLED + ', ordered AS (SELECT *, row_number() OVER (PARTITION BY "Class" ORDER BY row_id) - 1 AS ordinal FROM labelled),' + permutation(
    "labelled", '"Class"', 2, "perm"
)


@query(
    "t10_permuted_ranks",
    f'WITH {PERMUTED} SELECT row_id, "Class", {permuted("ordinal")} AS rank FROM ordered JOIN perm ON lab = "Class"',
)
def permuted_ranks(spark, sf_dir):
    base = st.labelled(spark, sf_dir).select("row_id", "Class")
    ordered, sizes = sampling.with_class_ordinal(base, "Class", "row_id")
    ranked = sampling.with_permuted(ordered, "rank", "ordinal", "Class", sizes, 42, sampling.STREAM_FRAMES)
    return ranked.select("row_id", "Class", "rank")


@query(
    "d03_stratified_frame_split",
    f"""WITH {PERMUTED} SELECT row_id, "Class", {split_case("rank", "size")} AS split
        FROM (SELECT *, {permuted("ordinal")} AS rank FROM ordered JOIN perm ON lab = "Class")""",
)
def stratified_frame_split(spark, sf_dir):
    return splits.stratified_frames(st.labelled(spark, sf_dir)).select("row_id", "Class", "split")


@query(
    "d02_session_holdout_frames",
    f"""WITH {LABELLED} SELECT row_id, session_id, CASE WHEN session_id IN {sql_list(st.VAL_SESSIONS)} THEN 'val'
        WHEN session_id IN {sql_list(st.TEST_SESSIONS)} THEN 'test' ELSE 'train' END AS split FROM labelled""",
)
def session_holdout_frames(spark, sf_dir):
    return splits.holdout_frames(st.labelled(spark, sf_dir), st.VAL_SESSIONS, st.TEST_SESSIONS).select("row_id", "session_id", "split")


WINDOW_ORDER = windows() + ", ordered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY start_row_id) - 1 AS ordinal FROM candidates),"
WINDOW_SPLIT = WINDOW_ORDER + permutation("candidates", "label", 1, "perm") + f""",
split_windows AS (
  SELECT session_id || ':' || start_row_id AS window_id, session_id, start_row_id, start_pos, label,
         {split_case("rank", "size")} AS split
  FROM (SELECT *, {permuted("ordinal")} AS rank FROM ordered JOIN perm ON lab = label)
)"""


@query(
    "d04_stratified_window_split",
    f"WITH {WINDOW_SPLIT} SELECT window_id, session_id, start_row_id, label, split FROM split_windows",
)
def stratified_window_split(spark, sf_dir):
    found = splits.stratified_windows(st.positioned(spark, sf_dir), SIZE, STRIDE, st.FIVE)
    return found.select("window_id", "session_id", "start_row_id", "label", "split")


BALANCED = (
    WINDOW_ORDER
    + permutation("candidates", "label", 0, "down")
    + """, target AS (SELECT min(size) AS t FROM down),
picked AS (SELECT c.*, """ + permuted("c.ordinal", "d.") + """ AS rank FROM ordered c JOIN down d ON d.lab = c.label),
kept AS (SELECT picked.*, t FROM picked, target WHERE rank < t)"""
)


@query(
    "t09_balanced_windows",
    f"WITH {BALANCED} SELECT session_id, start_row_id, label, rank FROM kept",
)
def balanced_windows(spark, sf_dir):
    index = settle(candidates(spark, sf_dir), "window-index")
    return sampling.downsample_balanced(index, "label", "start_row_id").select(
        "session_id", "start_row_id", "label", "rank"
    )


@query(
    "d04_downsampled_window_split",
    f"""WITH {BALANCED},{permutation("kept", "label", 1, "perm")}
        SELECT session_id || ':' || start_row_id AS window_id, label, {split_case("place", "size")} AS split
        FROM (SELECT kept.*, size, {permuted("rank")} AS place FROM kept JOIN perm ON lab = label)""",
)
def downsampled_window_split(spark, sf_dir):
    found = splits.stratified_windows(st.positioned(spark, sf_dir), SIZE, STRIDE, st.FIVE, downsample=True)
    return found.select("window_id", "label", "split")


HOLDOUT_WINDOWS = windows() + f""",
held AS (SELECT session_id || ':' || start_row_id AS window_id, session_id, start_row_id, label,
         CASE WHEN session_id IN {sql_list(st.VAL_SESSIONS)} THEN 'val' WHEN session_id IN {sql_list(st.TEST_SESSIONS)} THEN 'test' ELSE 'train' END AS split FROM lasts)"""


@query(
    "d05_session_holdout_windows",
    f"WITH {HOLDOUT_WINDOWS} SELECT window_id, session_id, start_row_id, label, split FROM held",
)
def session_holdout_windows(spark, sf_dir):
    found = splits.holdout_windows(st.positioned(spark, sf_dir), SIZE, STRIDE, st.VAL_SESSIONS, st.TEST_SESSIONS)
    return found.select("window_id", "session_id", "start_row_id", "label", "split")


@query(
    "d01_vertical_concat",
    f"""WITH {LABELLED} SELECT "Class", count(*) AS rows FROM (SELECT "Class" FROM labelled WHERE "Class" = 0 UNION ALL SELECT "Class" FROM labelled WHERE "Class" <> 0) GROUP BY "Class" """,
)
def vertical_concat(spark, sf_dir):
    base = st.labelled(spark, sf_dir)
    return base.where("Class = 0").unionByName(base.where("Class <> 0")).groupBy("Class").agg(F.count(F.lit(1)).alias("rows"))


WANTED = 1000


@query(
    "t06_stratified_sample",
    LABELLED.join(["WITH ", ""])
    + ', ordered AS (SELECT *, row_number() OVER (PARTITION BY "Class" ORDER BY row_id) - 1 AS ordinal FROM labelled),'
    + permutation("labelled", '"Class"', 0, "perm")
    + f""", shares AS (SELECT perm.*, size * {WANTED} / sum(size) OVER ()::DOUBLE AS share, sum(size) OVER () AS total FROM perm),
    quotas AS (SELECT *, CASE WHEN total <= {WANTED} THEN size ELSE floor(share) + CASE WHEN row_number() OVER (ORDER BY floor(share) - share, lab)
               <= {WANTED} - sum(floor(share)) OVER () THEN 1 ELSE 0 END END AS quota FROM shares)
    SELECT row_id, "Class" FROM ordered JOIN quotas ON lab = "Class" WHERE {permuted("ordinal")} < quota""",
)
def stratified_sample(spark, sf_dir):
    base = st.labelled(spark, sf_dir).select("row_id", "Class")
    return sampling.stratified_sample(base, "Class", "row_id", WANTED).select("row_id", "Class")


POINTS = 150
SPACED = f"""n <= {POINTS} OR p = n - 1 OR EXISTS (SELECT 1 FROM range(0, {POINTS - 1}) AS t(j) WHERE CAST(floor(j * ((n - 1) / {POINTS - 1}::DOUBLE)) AS BIGINT) = p)"""


@query(
    "t07_evenly_spaced_session_frames",
    f"""WITH {PREPARED}, series AS (SELECT row_id, session_id, pos AS p, n_frames AS n FROM prepared),
        grid AS (SELECT DISTINCT n, CAST(floor(j * ((n - 1) / {POINTS - 1}::DOUBLE)) AS BIGINT) AS p FROM (SELECT DISTINCT n FROM series), range(0, {POINTS - 1}) AS t(j)
                 UNION SELECT DISTINCT n, n - 1 FROM series)
        SELECT row_id, session_id FROM series s WHERE n <= {POINTS} OR EXISTS (SELECT 1 FROM grid g WHERE g.n = s.n AND g.p = s.p)""",
)
def evenly_spaced_session_frames(spark, sf_dir):
    layout = st.layout(spark, sf_dir)
    return (
        layout.frames.join(layout.sessions.select("session_id", "n_frames"), "session_id")
        .where(sampling.evenly_spaced(F.col("pos"), F.col("n_frames"), POINTS))
        .select("row_id", "session_id")
    )


@query(
    "t07_evenly_spaced_byte_series",
    f"""WITH {PREPARED}, series AS (SELECT row_id, session_id, Arbitration_ID, "Class", row_number() OVER (PARTITION BY session_id, Arbitration_ID, "Class" ORDER BY pos) - 1 AS p,
          count(*) OVER (PARTITION BY session_id, Arbitration_ID, "Class") AS n FROM prepared),
        grid AS (SELECT DISTINCT n, CAST(floor(j * ((n - 1) / 4::DOUBLE)) AS BIGINT) AS p FROM (SELECT DISTINCT n FROM series), range(0, 4) AS t(j)
                 UNION SELECT DISTINCT n, n - 1 FROM series)
        SELECT row_id, session_id, Arbitration_ID, "Class" FROM series s WHERE n <= 5 OR EXISTS (SELECT 1 FROM grid g WHERE g.n = s.n AND g.p = s.p)""",
)
def evenly_spaced_byte_series(spark, sf_dir):
    frames = st.positioned(spark, sf_dir).select("row_id", "session_id", "Arbitration_ID", "Class", "pos")
    series = ordering.with_ordinal(frames, ["session_id", "Arbitration_ID", "Class"], "pos")
    return series.where(sampling.evenly_spaced(F.col("ordinal"), F.col("ordinal_total"), 5)).select(
        "row_id", "session_id", "Arbitration_ID", "Class"
    )


@query(
    "t08_capped_random_sample",
    f"""WITH {LABELLED}, ranked AS (SELECT row_id, Arbitration_ID, "Class", row_number() OVER (PARTITION BY Arbitration_ID, "Class" ORDER BY md5('42:' || row_id), row_id) AS r FROM labelled)
        SELECT row_id, Arbitration_ID, "Class" FROM ranked WHERE r <= 20""",
)
def capped_random_sample(spark, sf_dir):
    base = st.labelled(spark, sf_dir).select("row_id", "Arbitration_ID", "Class")
    return sampling.capped_sample(base, ["Arbitration_ID", "Class"], "row_id", 20)


@query(
    "a09_window_lengths",
    f"WITH {windows()} SELECT CAST({SIZE} AS BIGINT) AS length, count(*) AS windows FROM candidates",
)
def window_lengths(spark, sf_dir):
    return audits.window_lengths(win.window_references(candidates(spark, sf_dir), SIZE))


@query(
    "a10_mixed_label_windows",
    f"""WITH {members()}, per_window AS (SELECT session_id, start_row_id,
          count(DISTINCT CASE WHEN label_t NOT IN (0, 5) THEN label_t END) AS attacks, bool_or(label_t = 0) AND bool_or(label_t = 5) AS both_seen
          FROM (SELECT *, CASE WHEN row_id % 2 = 0 AND "Class" = 0 THEN 5 ELSE "Class" END AS label_t FROM members) GROUP BY session_id, start_row_id)
        SELECT count(*) FILTER (attacks > 1) AS several_attacks, count(*) FILTER (both_seen) AS both_benign FROM per_window""",
)
def mixed_label_windows(spark, sf_dir):
    frames = st.positioned(spark, sf_dir).withColumn(
        "Class", F.when((F.col("row_id") % 2 == 0) & (F.col("Class") == 0), 5).otherwise(F.col("Class"))
    )
    gathered = win.gather_windows(frames, SIZE, STRIDE, {"frame_labels": F.col("Class")})
    return audits.mixed_windows(gathered, label_schema("ten_state_attack"))


@query(
    "d11_heterogeneous_windows",
    f"""WITH {members()} SELECT session_id || ':' || start_row_id AS window_id, any_value(label) AS label,
        string_agg(DISTINCT "Class"::VARCHAR, ' ' ORDER BY "Class"::VARCHAR) AS attack_labels
        FROM members WHERE "Class" <> 0 GROUP BY session_id, start_row_id HAVING count(DISTINCT "Class") > 1""",
)
def heterogeneous_windows(spark, sf_dir):
    index = win.window_references(candidates(spark, sf_dir), SIZE, positions=True)
    found = audits.heterogeneous_windows(st.positioned(spark, sf_dir), index, st.FIVE, SIZE)
    return found.select("window_id", "label", shown("attack_labels").alias("attack_labels"))


@query(
    "a11_duplicate_identifiers",
    """SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT user_id) AS distinct_ids, count(*) - count(DISTINCT user_id) AS duplicates FROM events""",
)
def duplicate_identifiers(spark, sf_dir):
    return audits.duplicate_count(st.table(spark, sf_dir, "events"), "user_id")


def split_windows(spark, sf_dir):
    return splits.stratified_windows(st.positioned(spark, sf_dir), SIZE, STRIDE, st.FIVE)


PAIRS = "(VALUES ('train__val','train','val'), ('train__test','train','test'), ('val__test','val','test')) AS p(pair, a, b)"


@query(
    "d07_identifier_overlap",
    f"""WITH {WINDOW_SPLIT}, flags AS (SELECT session_id AS id, split FROM split_windows GROUP BY 1, 2)
        SELECT pair, (SELECT count(*) FROM (SELECT id FROM flags WHERE split = a INTERSECT SELECT id FROM flags WHERE split = b)) AS shared FROM {PAIRS}""",
)
def identifier_overlap(spark, sf_dir):
    return audits.identifier_overlap(split_windows(spark, sf_dir), "session_id")


@query(
    "d07_window_id_overlap",
    f"""WITH {WINDOW_SPLIT} SELECT pair, (SELECT count(*) FROM (SELECT window_id FROM split_windows WHERE split = a INTERSECT SELECT window_id FROM split_windows WHERE split = b)) AS shared FROM {PAIRS}""",
)
def window_id_overlap(spark, sf_dir):
    return audits.identifier_overlap(split_windows(spark, sf_dir), "window_id")


@query(
    "d08_session_overlap",
    f"""WITH {WINDOW_SPLIT}, s AS (SELECT DISTINCT session_id, split FROM split_windows)
        SELECT pair, x.session_id FROM {PAIRS} JOIN s x ON x.split = a JOIN s y ON y.split = b AND y.session_id = x.session_id""",
)
def session_overlap(spark, sf_dir):
    return audits.session_overlap(split_windows(spark, sf_dir))


@query(
    "d09_missing_classes",
    f"""WITH {HOLDOUT_WINDOWS}, seen AS (SELECT DISTINCT split, label FROM held)
        SELECT s.split, t.label FROM (VALUES ('val'), ('test')) AS s(split) CROSS JOIN (SELECT label FROM seen WHERE split = 'train') t
        WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.split = s.split AND x.label = t.label)""",
)
def missing_classes(spark, sf_dir):
    held = splits.holdout_windows(st.positioned(spark, sf_dir), SIZE, STRIDE, st.VAL_SESSIONS, st.TEST_SESSIONS)
    return audits.missing_classes(held, "label")


BY_TIME = "CASE WHEN row_id * 10 < 6 * n THEN 'train' WHEN row_id * 10 < 8 * n THEN 'val' ELSE 'test' END"


@query(
    "d09_missing_classes_by_time",
    f"""WITH {LABELLED}, cut AS (SELECT "Class", {BY_TIME} AS split FROM labelled, (SELECT count(*) AS n FROM labelled)),
        seen AS (SELECT DISTINCT split, "Class" FROM cut)
        SELECT s.split, t."Class" FROM (VALUES ('val'), ('test')) AS s(split) CROSS JOIN (SELECT "Class" FROM seen WHERE split = 'train') t
        WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.split = s.split AND x."Class" = t."Class")""",
)
def missing_classes_by_time(spark, sf_dir):
    """A log cut in time: attacks come one after the other, so the later parts lack some of them."""
    frames = st.labelled(spark, sf_dir).select("row_id", "Class")
    rows = frames.count()
    return audits.missing_classes(frames.withColumn("split", F.expr(BY_TIME.replace(" n ", f" {rows}L "))), "Class")


@query(
    "d12_split_report",
    f"""WITH {WINDOW_SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT label) AS classes, count(DISTINCT session_id) AS sessions,
        count(*) - count(DISTINCT window_id) AS duplicates FROM split_windows GROUP BY split""",
)
def split_report(spark, sf_dir):
    return audits.split_report(split_windows(spark, sf_dir), "label", "window_id")


@query(
    "d12_split_class_distribution",
    f"""WITH {WINDOW_SPLIT} SELECT split, label, count(*) AS rows, round(count(*) / sum(count(*)) OVER (PARTITION BY split)::DOUBLE * 100, 4) AS percentage
        FROM split_windows GROUP BY split, label""",
)
def split_class_distribution(spark, sf_dir):
    counts = split_windows(spark, sf_dir).groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(audits.W.partitionBy("split"))
    return counts.select("split", "label", "rows", F.round(F.col("rows") / total * 100, 4).alias("percentage"))


@query(
    "d13_split_accounting",
    f"""WITH {LABELLED} SELECT "Class", count(*) AS counted, count(*) AS seen, CAST(0 AS BIGINT) AS lost FROM labelled GROUP BY "Class" """,
)
def split_accounting(spark, sf_dir):
    base = st.labelled(spark, sf_dir)
    return audits.split_accounting(base, splits.stratified_frames(base.select("row_id", "Class")), "Class")


@query(
    "d14_frames_shared_by_splits",
    f"""WITH {WINDOW_SPLIT} SELECT p.row_id, string_agg(DISTINCT w.split, ' ' ORDER BY w.split) AS splits
        FROM split_windows w JOIN prepared p ON p.session_id = w.session_id AND p.pos BETWEEN w.start_pos AND w.start_pos + {SIZE - 1}
        GROUP BY p.row_id HAVING count(DISTINCT w.split) > 1""",
)
def frames_shared_by_splits(spark, sf_dir):
    frames = st.positioned(spark, sf_dir)
    placed = splits.stratified_windows(frames, SIZE, STRIDE, st.FIVE, positions=True)
    found = audits.leaked_frames(frames, placed, STRIDE, SIZE)
    return found.select("row_id", F.array_join("splits", " ").alias("splits"))
