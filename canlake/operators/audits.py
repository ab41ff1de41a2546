"""Leakage, coverage and quality audits of frames, windows and splits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from canlake.functions.labels import is_benign
from canlake.operators.splits import SPLITS
from canlake.operators.windows import counts_beside, with_start
from canlake.schemas import LabelSchema


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percentage (4 decimals) per label; the total runs over one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(W.partitionBy())
    return counts.select(label, "rows", F.round(F.col("rows") / total * 100, 4).alias("percentage"))


def session_row_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))


def session_summary(df: DataFrame, schema: LabelSchema) -> DataFrame:
    """Frames, time range and attack classes per session.

    Frames are reduced to one row per session and class before classes are collected.
    """
    per_class = df.groupBy("session_id", "Class").agg(
        F.count(F.lit(1)).alias("n"), F.min("Timestamp").alias("t_min"), F.max("Timestamp").alias("t_max")
    )
    return (
        per_class.groupBy("session_id")
        .agg(
            F.sum("n").alias("frames"),
            F.count("Class").cast("int").alias("classes"),
            F.min("t_min").alias("t_first"),
            F.max("t_max").alias("t_last"),
            F.array_sort(F.collect_set(F.when(~is_benign("Class", schema), F.col("Class")))).alias("attack_classes"),
        )
        .withColumn("duration", F.col("t_last") - F.col("t_first"))
    )


def capture_audit(lines: DataFrame) -> DataFrame:
    """Per raw file and source label: rows and time range; says if sub-labels exist."""
    return lines.groupBy("file", "source_label", "has_subclass").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("Timestamp").alias("t_min"),
        F.max("Timestamp").alias("t_max"),
    )


def window_lengths(df: DataFrame) -> DataFrame:
    """Histogram of window lengths, from a size column or from expanded frames."""
    length = F.col("window_size") if "window_size" in df.columns else F.size("frame_labels").cast("long")
    return df.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("windows"))


def mixed_windows(expanded: DataFrame, schema: LabelSchema) -> DataFrame:
    """Windows with several attack labels, and windows holding every benign label."""
    attacks = F.array_distinct(F.filter("frame_labels", lambda x: ~x.isin(*schema.benign)))
    every_benign = F.lit(len(schema.benign) > 1)
    for label in schema.benign:
        every_benign = every_benign & F.array_contains("frame_labels", label)
    return expanded.agg(
        F.count_if(F.size(attacks) > 1).alias("several_attacks"),
        F.count_if(every_benign).alias("both_benign"),
    )


def heterogeneous_windows(frames: DataFrame, index: DataFrame, schema: LabelSchema, size: int | None = None) -> DataFrame:
    """Windows of an index holding more than one attack label, with those labels.

    Attack frames and windows move once, by block of positions; a window finds the frames
    of each class in its range from running counts.  ``size`` is the index's window size,
    looked up when not given.
    """
    if size is None:
        sizes = [r[0] for r in index.select("window_size").distinct().collect()]  # an index has one size
        if len(sizes) != 1:
            parts = [heterogeneous_windows(frames, index.where(F.col("window_size") == n), schema, n) for n in sizes or [1]]
            return reduce(DataFrame.unionByName, parts)
        size = sizes[0]
    classes = [c for c in range(schema.num_classes) if c not in schema.benign]
    names = [f"class_{c}" for c in classes]
    attacks = frames.where(~is_benign("Class", schema)).select(
        "session_id", "pos", *[(F.col("Class") == c).cast("int").alias(n) for c, n in zip(classes, names)]
    )
    starts = with_start(index, frames).select("window_id", "session_id", "start_row_id", "label", F.col("start_pos").alias("pos"))
    seen = counts_beside(attacks, starts, names, (0, size - 1))
    labels = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(c)) for c, n in zip(classes, names)]))
    return seen.select("window_id", "session_id", "start_row_id", "label", labels.alias("attack_labels")).where(F.size("attack_labels") > 1)


def require_homogeneous(frames: DataFrame, index: DataFrame, schema: LabelSchema) -> None:
    """Fail on the first window with several attack labels, naming it."""
    found = heterogeneous_windows(frames, index, schema).limit(1).collect()
    if found:
        raise ValueError(f"window with several attack labels: {found[0].asDict()}")


def duplicate_count(df: DataFrame, identifier: str) -> DataFrame:
    """Rows minus distinct identifiers, counted per identifier so nothing is collected."""
    per_id = df.groupBy(identifier).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def identifier_overlap(split_table: DataFrame, identifier: str) -> DataFrame:
    """For each pair of splits, how many identifiers occur in both.

    One aggregation of three flags per identifier serves all pairs.
    """
    flags = split_table.groupBy(identifier).agg(
        *[F.max((F.col("split") == name).cast("int")).alias(name) for name in SPLITS]
    )
    pairs = list(combinations(SPLITS, 2))
    totals = flags.agg(
        *[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}__{b}") for a, b in pairs]
    )
    return totals.select(
        F.inline(
            F.array(*[F.struct(F.lit(f"{a}__{b}").alias("pair"), F.col(f"{a}__{b}").alias("shared")) for a, b in pairs])
        )
    )


def session_overlap(split_table: DataFrame) -> DataFrame:
    """Sessions that occur in more than one split, per pair."""
    flags = split_table.groupBy("session_id").agg(
        *[F.max((F.col("split") == name).cast("int")).alias(name) for name in SPLITS]
    )
    pairs = F.array(
        *[
            F.when((F.col(a) == 1) & (F.col(b) == 1), F.lit(f"{a}__{b}"))
            for a, b in combinations(SPLITS, 2)
        ]
    )
    return flags.select(F.explode(F.array_compact(pairs)).alias("pair"), "session_id")


def missing_classes(split_table: DataFrame, label: str) -> DataFrame:
    """Training classes that validation or test lacks; empty when coverage is complete."""
    seen = split_table.select("split", label).distinct()
    train = seen.where("split = 'train'").select(label)
    wanted = train.select(F.explode(F.array(F.lit("val"), F.lit("test"))).alias("split"), label)
    return wanted.join(seen, ["split", label], "left_anti")


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null counts per column; every count should be 0."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns]))
    )


def split_accounting(source: DataFrame, split_table: DataFrame, label: str) -> DataFrame:
    """Rows per class before and after a split; ``lost`` must be 0 everywhere."""
    before = source.groupBy(label).agg(F.count(F.lit(1)).alias("counted"))
    after = split_table.groupBy(label).agg(F.count(F.lit(1)).alias("seen"))
    return before.join(after, label, "full_outer").select(
        label,
        F.coalesce("counted", F.lit(0)).alias("counted"),
        F.coalesce("seen", F.lit(0)).alias("seen"),
        (F.coalesce("counted", F.lit(0)) - F.coalesce("seen", F.lit(0))).alias("lost"),
    )


def split_report(split_table: DataFrame, label: str, identifier: str) -> DataFrame:
    """One row per split: rows, classes, sessions and duplicate identifiers."""
    per_id = split_table.groupBy("split", "session_id", label, identifier).agg(F.count(F.lit(1)).alias("n"))
    per_session = per_id.groupBy("split", "session_id", label).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("extra")
    )
    return per_session.groupBy("split").agg(
        F.sum("n").alias("rows"),
        F.countDistinct(label).alias("classes"),
        F.countDistinct("session_id").alias("sessions"),
        F.sum("extra").alias("duplicates"),
    )


def leaked_frames(frames: DataFrame, split_windows: DataFrame, stride: int, size: int) -> DataFrame:
    """Frames lying in windows of two or more splits (stride below window size).

    Frames and windows move once, by block of positions; a frame counts the windows of
    each split that begin up to ``size`` - 1 frames before it.
    """
    begins = with_start(split_windows, frames).select(
        "session_id", F.col("start_pos").alias("pos"), *[(F.col("split") == name).cast("int").alias(name) for name in SPLITS]
    )
    seen = counts_beside(begins, frames.select("session_id", "row_id", "pos"), list(SPLITS), (1 - size, 0))
    return seen.where(sum((F.col(name) > 0).cast("int") for name in SPLITS) > 1).select(
        "session_id", "row_id",
        F.array_sort(F.array_compact(F.array(*[F.when(F.col(n) > 0, n) for n in SPLITS]))).alias("splits"),
    )


class Contract:
    """Rules of a table, counted while it is read for something else.

    ``watched`` gives the table back with the counts hung on it; after any action on that,
    ``report`` has one row for each rule.  No extra pass is made.
    """

    def __init__(self, rules: dict[str, Column], required: tuple[str, ...] = ()):
        self.rules, self.required = rules, required
        self.observation = Observation()

    def watched(self, df: DataFrame) -> DataFrame:
        self.absent = len(set(self.required) - set(df.columns))
        return df.observe(
            self.observation, F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.coalesce(broken, F.lit(True))).alias(name) for name, broken in self.rules.items()],
        )

    def report(self, spark: SparkSession) -> DataFrame:
        """rule, broken (rows; columns for ``missing_columns``), rows."""
        found = self.observation.get
        rows = [("missing_columns", self.absent, found["rows"]), *((name, found[name], found["rows"]) for name in self.rules)]
        return spark.createDataFrame(rows, "rule string, broken long, rows long")
