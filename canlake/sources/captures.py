"""From a folder of raw captures to the canonical frame table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from canlake.schemas import CANONICAL
from canlake.sources import candump, delimited
from canlake.sources.discovery import dialect_glob, is_excluded, read_lines, select_captures
from canlake.storage import settle

PARSERS = {
    "car_hacking_attack_defense": delimited.parse_attack_defense,
    "hcrl_carhacking": delimited.parse_hcrl,
    "can_mirgu": candump.parse_mirgu,
    "ciciov2024": delimited.parse_ciciov,
    "survival_analysis": delimited.parse_survival,
}


def parser_for(dialect: str, injections: DataFrame | None = None):
    """The line parser of a dialect; ROAD also needs its injection table."""
    dialect_glob(dialect)
    if dialect == "road_raw":
        if injections is None:
            raise ValueError("ROAD captures need their injection metadata")
        return partial(candump.parse_road, injections=injections)
    return PARSERS[dialect]


def selected_lines(
    spark: SparkSession,
    folder: str,
    dialect: str,
    variant: str | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    lines = read_lines(spark, folder, dialect)
    if exclude:
        lines = lines.where(~is_excluded(F.col("path"), folder, exclude))
    return select_captures(lines, dialect, variant)


def with_row_ids(parsed: DataFrame) -> DataFrame:
    """Dense ``row_id`` over files in path order and lines in file order.

    Good lines per (file, split) are counted first.  Offsets add up along the splits
    of a file and along the files; only the file totals, one row per capture, meet
    in one window.  In a split whose good lines have successive keys the place of a
    line is its key's distance from the first one, so they stay where they lie; the
    lines of other splits are numbered inside their own split.  A key occurs once in
    a split.
    """
    counts = parsed.groupBy("path", "file_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_key").alias("first_key"), F.max("line_key").alias("last_key")
    )
    in_file = W.partitionBy("path").orderBy("file_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = settle(
        counts.withColumn("in_file", F.coalesce(F.sum("n").over(in_file), F.lit(0))), "file-blocks"
    )
    earlier = W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    files = blocks.groupBy("path").agg(F.sum("n").alias("file_rows")).withColumn(
        "before_file", F.coalesce(F.sum("file_rows").over(earlier), F.lit(0))
    )
    starts = settle(
        blocks.join(files, "path").select(
            "path", "file_block", (F.col("before_file") + F.col("in_file")).alias("start"), "first_key",
            (F.col("last_key") - F.col("first_key") + 1 == F.col("n")).alias("gapless"),
        ),
        "row-starts",
    )
    # A split is known by its first row id from here on: sorting and moving a number, not a path.
    placed = parsed.join(starts, ["path", "file_block"]).drop("path", "file_block")
    inside = W.partitionBy("start").orderBy("line_key")
    successive = placed.where("gapless").withColumn("_n", F.col("line_key") - F.col("first_key"))
    others = placed.where("NOT gapless").withColumn("_n", F.row_number().over(inside) - 1)
    return (
        successive.unionByName(others)
        .withColumn("row_id", (F.col("start") + F.col("_n")).cast("long"))
        .drop("_n", "start", "first_key", "gapless", "line_key")
    )


def canonical_order(frames: DataFrame) -> DataFrame:
    return frames.select(*[f for f in CANONICAL.fieldNames() if f in frames.columns])
