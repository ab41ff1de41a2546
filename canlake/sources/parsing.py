"""What the line parsers share: fields, headers, rejects and the canonical projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from canlake.schemas import BYTE_COLUMNS
from canlake.storage import settle

LINE_COLUMNS = ["path", "file_block", "line_key"]
SEPARATOR = "\u0001"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed exactly once per row.

    A later filter on a plain projected column is pushed below the projection and
    evaluates its expression a second time; it stops at an exploded one.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def filled(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("value") != "")


def matched(lines: DataFrame, pattern: str, groups: int) -> DataFrame:
    """Filled lines with the pattern's groups in array ``m`` (from index 1).

    One regular expression per line; ``well_formed`` is false where it did not match.
    """
    text = F.replace(F.trim("value"), F.lit(SEPARATOR), F.lit("?"))
    marks = "".join(f"{SEPARATOR}${i + 1}" for i in range(groups))
    parts = F.split(F.regexp_replace(text, pattern, marks), SEPARATOR, -1)
    return once(filled(lines), "m", parts).withColumn("well_formed", F.size("m") == groups + 1)


def group(index: int) -> Column:
    return F.get("m", F.lit(index))


def reasons(*checks: tuple[str, Column]) -> Column:
    """Name of the first failed check; null for a good line."""
    out = None
    for name, failed in checks:
        failed = F.coalesce(failed, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def canonical(parsed: DataFrame) -> DataFrame:
    """Canonical columns, the line's place, and ``reject_reason``."""
    time = ["Timestamp"] if "Timestamp" in parsed.columns else []
    kept = [c for c in LINE_COLUMNS if c in parsed.columns]
    return parsed.select(
        *kept, "session_id", *time, "Arbitration_ID", F.col("DLC").cast("short").alias("DLC"),
        *BYTE_COLUMNS, "attack_type", "reject_reason",
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NULL").drop("reject_reason")


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Rejected lines per capture and reason."""
    return (
        parsed.where("reject_reason IS NOT NULL")
        .groupBy("session_id", "reject_reason")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def captures_without_frames(parsed: DataFrame) -> DataFrame:
    """Captures in which not a single line was good."""
    return (
        parsed.groupBy("session_id")
        .agg(F.count_if(F.col("reject_reason").isNull()).alias("good"))
        .where("good = 0")
        .select("session_id")
    )


def with_header(lines: DataFrame, names: list[str], marker: str) -> DataFrame:
    """Data lines as ``cells``, with the place of each named column in their own file.

    Files of one folder may have different headers.  A file's header is its first line
    that names the ``marker`` column; only such lines are aggregated, and the table of
    places, one row per file, is joined back.  A file without header has no places.
    """
    in_file = F.struct("file_block", "line_key")
    heads = lines.where(F.col("value").contains(marker)).groupBy("path").agg(
        F.min_by("value", in_file).alias("head"), F.min_by("line_key", in_file).alias("head_key")
    )
    header = F.transform(F.split("head", ","), F.trim)
    places = settle(
        heads.select(
            "path", "head_key",
            *[(F.array_position(header, F.lit(n)).cast("int") - 1).alias(place(n)) for n in names],
        ),
        "headers",
    )
    rows = filled(lines).join(places, "path", "left").where("NOT (line_key <=> head_key)")
    return once(rows, "cells", F.split("value", ",", -1)).drop("head_key")


def place(name: str) -> str:
    return f"_at_{name}"


def has_column(name: str) -> Column:
    return F.coalesce(F.col(place(name)) >= 0, F.lit(False))


def cell(name: str, cells: str = "cells") -> Column:
    """Cell of a named column; null when the file lacks the column or the cell is empty."""
    return F.nullif(F.get(F.col(cells), F.col(place(name))), F.lit(""))


def staged(parsed: DataFrame) -> DataFrame:
    """Parsed lines on disk, keyed by (path, file_block, line_key).

    File facts, row ids, frames and rejects all derive from this table, so the raw text
    is read and matched once, and a line keeps its key whatever happens to an executor.
    """
    return settle(parsed, "parsed-lines")


def with_capture_facts(fields: DataFrame, family: Column) -> DataFrame:
    """Adds ``t_first``, the time of the file's first good line, and its ``family``.

    Both belong to the file, so they are worked out on one row per file.  ``fields`` has
    ``well_formed`` and ``raw_time`` and is read twice: stage it first.
    """
    timed = fields.where("well_formed AND raw_time IS NOT NULL")
    firsts = timed.groupBy("path", "session_id").agg(F.min_by("raw_time", F.struct("file_block", "line_key")).alias("t_first"))
    facts = settle(firsts.select("path", "t_first", family.alias("family")), "capture-facts")
    return fields.join(facts, "path", "left")


def beyond(cells: Column, width: int) -> Column:
    """Whether there is a filled cell after the first ``width``."""
    rest = F.slice(cells, width + 1, F.greatest(F.size(cells) - width, F.lit(0)))
    return (F.size(cells) > width) & (F.trim(F.array_join(rest, "")) != "")
