"""Comma-separated and labelled-text dialects.

Upper case, ``0x`` prefixes and trailing decimals are dealt with on the whole line
before it is cut into cells, instead of cell by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from canlake.functions import labels
from canlake.functions.hexfields import PAD, canonical_id, pad_left
from canlake.schemas import BYTE_COLUMNS
from canlake.sources.parsing import (
    beyond, canonical, cell, filled, group, has_column, matched, once, place, reasons, with_header,
)

# Line format of the labelled text, columns of the headed CSVs.
LABELLED_LINE = r"^.*?Timestamp:\s*(\S+)\s+ID:\s*(\S+)\s+\S+\s+DLC:\s*(\d+)\s*(.*)$"
CICIOV_REQUIRED = ["ID", "label", "specific_class", *[f"DATA_{i}" for i in range(8)]]
RAGGED_WIDTH = 12
KNOWN_BYTE = "^([0-9a-f]{1,2}|[0-9A-F]{1,2})$"
PLAIN_BYTES = r"\A(?:[0-9a-f]{2}(?:,[0-9a-f]{2})*|[0-9A-F]{2}(?:,[0-9A-F]{2})*)\z"
HEX_TEXT = "^(0[xX])?[0-9A-Fa-f]+$"
HEX_PREFIX = r"(^|,|\s)\s*0X"
DECIMALS = r"\.[0-9]+(?=\s*(,|$))"


def parse_attack_defense(lines: DataFrame) -> DataFrame:
    """Header CSV; sub-label if the file has one, else label, else ``Normal``.

    Bytes stay as written; a line with more than eight is rejected.
    """
    rows = with_header(lines, ["Timestamp", "Arbitration_ID", "DLC", "Data", "SubClass", "Class"], "Arbitration_ID")
    label = F.when(has_column("SubClass"), cell("SubClass")).when(has_column("Class"), cell("Class"))
    rows = rows.withColumns(
        {
            "Timestamp": cell("Timestamp").try_cast("double"),
            "Arbitration_ID": canonical_id(cell("Arbitration_ID")),
            "DLC": F.trim(cell("DLC")).try_cast("short"),
            "attack_type": F.trim(F.coalesce(label, F.lit("Normal"))),
            "bytes": F.split(cell("Data"), " "),
        }
    )
    reason = reasons(
        ("bad_time", F.col("Timestamp").isNull()),
        ("bad_id", F.col("Arbitration_ID").isNull()),
        ("bad_dlc", F.col("DLC").isNull()),
        ("too_many_bytes", beyond(F.col("bytes"), len(BYTE_COLUMNS))),
    )
    data = [F.coalesce(F.get("bytes", F.lit(i)), F.lit(PAD)).alias(n) for i, n in enumerate(BYTE_COLUMNS)]
    return canonical(rows.withColumn("reject_reason", reason).select("*", *data))


def parse_ciciov(lines: DataFrame) -> DataFrame:
    """Header CSV without time; bracketed or absent DLC means 8, blank bytes are ``PAD``."""
    rows = with_header(lines, [*CICIOV_REQUIRED, "DLC"], "specific_class")
    plain = F.regexp_replace(F.regexp_replace(F.upper("value"), HEX_PREFIX, "$1"), DECIMALS, "")
    rows = once(rows, "hex", F.split(plain, r"\s*,\s*", -1))
    lacking = F.lit(False)
    for name in CICIOV_REQUIRED:
        lacking = lacking | ~has_column(name)
    shown = F.trim(F.translate(cell("DLC", "hex"), "[]\t\r\n", "     "))
    raw_class = F.upper(F.trim(cell("specific_class")))
    data = {}
    for i, name in enumerate(BYTE_COLUMNS):
        text = F.trim(F.get("hex", F.col(place(f"DATA_{i}"))))
        data[name] = F.when(F.coalesce(text, F.lit("")) == "", PAD).otherwise(pad_left(text, 2))
    rows = rows.withColumns(
        {
            "Arbitration_ID": pad_left(F.ltrim(F.trim(cell("ID", "hex")), F.lit("0")), 3),
            "attack_type": F.when(raw_class == "DOS", "DoS").otherwise(raw_class),
            "DLC": F.when(F.coalesce(shown, F.lit("")) == "", F.lit(8).cast("short")).otherwise(
                F.regexp_replace(shown, r"\.[0-9]+$", "").try_cast("short")
            ),
            **data,
        }
    )
    reason = reasons(
        ("missing_columns", lacking),
        ("bad_id", F.col("Arbitration_ID").isNull()),
        ("bad_label", F.col("attack_type").isNull()),
        ("bad_dlc", F.col("DLC").isNull()),
    )
    return canonical(rows.withColumn("reject_reason", reason))


def parse_hcrl_csv(lines: DataFrame) -> DataFrame:
    """Ragged CSV without header; the last filled cell is the T/R flag.

    Time, identifier, DLC, at most eight bytes and the flag: a line with more cells is rejected.
    """
    plain = F.regexp_replace(F.upper("value"), HEX_PREFIX, "$1")
    rows = once(filled(lines), "cells", F.split(plain, ",", -1))
    item = lambda i: F.nullif(F.get("cells", F.lit(i)), F.lit(""))
    flag = F.coalesce(*[item(i) for i in range(RAGGED_WIDTH - 1, 2, -1)])
    rows = rows.withColumns(
        {
            "Timestamp": item(0).try_cast("double"),
            "Arbitration_ID": canonical_id(item(1)),
            "DLC": F.trim(item(2)).try_cast("short"),
            "flag": F.trim(flag),
        }
    )
    data = [
        F.when(F.col("DLC") > i, pad_left(F.trim(item(i + 3)), 2)).otherwise(PAD).alias(name)
        for i, name in enumerate(BYTE_COLUMNS)
    ]
    family = labels.hcrl_family(F.col("session_id"))
    reason = reasons(
        ("bad_time", F.col("Timestamp").isNull()),
        ("bad_id", F.col("Arbitration_ID").isNull()),
        ("bad_dlc", F.col("DLC").isNull()),
        ("too_many_cells", beyond(F.col("cells"), RAGGED_WIDTH)),
    )
    return canonical(
        rows.withColumns(
            {"attack_type": F.when(F.col("flag") == "T", family).otherwise("Normal"), "reject_reason": reason}
        ).select("*", *data)
    )


def parse_hcrl_text(lines: DataFrame) -> DataFrame:
    """Labelled text of normal traffic; every frame is ``Normal``."""
    rows = matched(lines, LABELLED_LINE, 4)
    payload = F.trim(F.regexp_replace(F.upper(group(4)), HEX_PREFIX, "$1"))
    rows = once(rows, "bytes", F.split(payload, r"\s+"))
    data = {
        name: F.coalesce(pad_left(F.ltrim(byte_text(i), F.lit("0")), 2), F.lit(PAD))
        for i, name in enumerate(BYTE_COLUMNS)
    }
    rows = rows.withColumns(
        {
            "Timestamp": group(1).try_cast("double"),
            "Arbitration_ID": canonical_id(group(2)),
            "DLC": group(3).try_cast("short"),
            "attack_type": F.lit("Normal"),
            **data,
        }
    )
    reason = reasons(
        ("malformed", ~F.col("well_formed")),
        ("bad_time", F.col("Timestamp").isNull()),
        ("bad_id", ~group(2).rlike(HEX_TEXT)),
        ("too_many_bytes", beyond(F.col("bytes"), len(BYTE_COLUMNS))),
        ("bad_byte", ~F.concat(*BYTE_COLUMNS).rlike("^([0-9A-F]{2}|PAD){8}$")),
    )
    return canonical(rows.withColumn("reject_reason", reason))


def split_at(text: Column, pattern: str, mark: str, other: str) -> Column:
    """Splits at a pattern that matches more than ``mark`` only in texts that hold ``other``.

    Spark compiles the pattern of a split for every row; most rows need a plain split.
    """
    return F.split(F.when(text.rlike(other), F.regexp_replace(text, pattern, mark)).otherwise(text), mark, -1)


def byte_text(index: int) -> Column:
    return F.nullif(F.get("bytes", F.lit(index)), F.lit(""))


def parse_hcrl(lines: DataFrame) -> DataFrame:
    """Both file kinds of the corpus, told apart by their extension."""
    name = F.lower("path")
    return parse_hcrl_csv(lines.where(name.endswith(".csv"))).unionByName(
        parse_hcrl_text(lines.where(name.endswith(".txt")))
    )


def parse_survival(lines: DataFrame) -> DataFrame:
    """Comma lines with the payload either in one spaced cell or in cells before a flag."""
    rows = once(filled(lines), "cells", split_at(F.trim("value"), r"\s*,\s*", ",", r"\s,|,\s"))
    count = F.size("cells")
    fourth, last = F.get("cells", F.lit(3)), F.upper(F.get("cells", count - 1))
    rows = rows.withColumns(
        {
            "spaced": F.coalesce(fourth.contains(" "), F.lit(False)),
            "flagged": F.coalesce(~fourth.contains(" ") & last.isin("R", "T"), F.lit(False)),
            "injected": last == "T",
        }
    )
    wide = F.greatest(count - 3 - F.col("flagged").cast("int"), F.lit(0))
    parts = F.when(F.col("spaced"), split_at(fourth, r"\s+", " ", r"\s\s|[\t\n\x0B\f\r]")).otherwise(F.slice("cells", F.lit(4), wide))
    rows = once(rows, "bytes", parts)
    # A byte holds no comma.  One look at a line of plain bytes instead of one at each byte.
    plain = (F.size("bytes") <= len(BYTE_COLUMNS)) & F.array_join("bytes", ",").rlike(PLAIN_BYTES)
    rows = once(rows, "plain", plain)
    data = {}
    for i, name in enumerate(BYTE_COLUMNS):
        text = F.get("bytes", F.lit(i))
        known = F.when(F.col("plain"), F.lit(i) < F.size("bytes")).otherwise(text.rlike(KNOWN_BYTE))
        data[name] = F.when(known, F.lpad(F.upper(text), 2, "0")).otherwise(PAD)
    family = labels.survival_family(F.col("session_id"))
    raw_id = F.get("cells", F.lit(1))
    rows = rows.withColumns(
        {
            "Timestamp": F.get("cells", F.lit(0)).try_cast("double"),
            "DLC": F.get("cells", F.lit(2)).try_cast("short"),
            "Arbitration_ID": canonical_id(raw_id),
            "attack_type": F.when(F.col("flagged") & F.col("injected"), family).otherwise("Normal"),
            **data,
        }
    )
    reason = reasons(
        ("too_few_cells", count < 4),
        ("bad_time", F.col("Timestamp").isNull()),
        ("bad_id", ~raw_id.rlike(HEX_TEXT)),
        ("bad_dlc", F.col("DLC").isNull()),
        ("too_many_bytes", beyond(F.col("bytes"), len(BYTE_COLUMNS))),
        ("unknown_family", family.isNull()),
    )
    return canonical(rows.withColumn("reject_reason", reason))
