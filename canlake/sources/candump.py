"""candump logs: ROAD (labels rebuilt from injection metadata) and CAN-MIRGU (flagged)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from canlake.functions import labels
from canlake.functions.hexfields import bytes_of_payload
from canlake.sources.parsing import LINE_COLUMNS, canonical, group, matched, reasons, staged, with_capture_facts

# Line formats and identifier limits.
ROAD_LINE = r"(?s)^\(([^)]+)\)\s+\S+\s+([0-9A-Fa-f]+)#([0-9A-Fa-f]*).*$"
MIRGU_LINE = r"^\(([^)]+)\)\s+\S+\s+([0-9A-Fa-f]+)#([0-9A-Fa-f]*)\s+([01])\s*$"
ROAD_SCOPE = 0x700
ROAD_LIMIT = 0xFFF
MIRGU_LIMIT = 0x7FF
ANY_ID = "XXX"


def line_fields(lines: DataFrame, pattern: str, groups: int) -> DataFrame:
    """The pattern's groups of every line, staged: the only pass over the text."""
    return staged(
        matched(lines, pattern, groups).select(
            *LINE_COLUMNS, "session_id", "well_formed", group(1).try_cast("double").alias("raw_time"),
            F.ltrim(F.upper(group(2)), F.lit("0")).alias("raw_id"), F.upper(group(3)).alias("raw_payload"),
            group(4).alias("flag"),
        )
    )


def with_fields(lines: DataFrame) -> DataFrame:
    """Relative time, identifier, raw and left-padded payload, DLC.

    ``id_number`` is -1 for an identifier of more than three significant digits.
    """
    short = F.length("raw_id") <= 3
    return (
        lines.withColumns(
            {
                "id_number": F.when(short, F.conv(F.lpad("raw_id", 3, "0"), 16, 10).cast("int")).otherwise(-1),
                "Arbitration_ID": F.lpad("raw_id", 3, "0"),
                "Timestamp": F.col("raw_time") - F.col("t_first"),
                "payload": F.lpad("raw_payload", 16, "0"),
                "digits": F.length("raw_payload"),
            }
        )
        .withColumn("DLC", F.shiftright("digits", 1))
    )


def write_injections(injections: DataFrame, path: str) -> None:
    """The sidecar: one JSON object keyed by capture, an entry on each line.

    The lines are ordered by a shuffle and go through one writer as a stream; nothing
    holds all captures together.
    """
    entry = F.struct(
        F.array("t_lo", "t_hi").alias("injection_interval"),
        F.col("pattern").alias("injection_data_str"),
        F.col("target").alias("injection_id"),
    )
    one = F.to_json(F.create_map(F.col("session_id"), entry))
    keyed = injections.select(F.lit(1).alias("part"), "session_id", F.substr(one, F.lit(2), F.length(one) - 2).alias("value"))
    first = injections.agg(F.min("session_id").alias("first"))
    marked = keyed.join(first.select(F.col("first").alias("session_id"), F.lit(True).alias("leads")), "session_id", "left")
    entries = marked.select("part", "session_id", F.concat(F.when(F.col("leads"), "").otherwise(","), "value").alias("value"))
    ends = injections.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], entries.schema)
    entries.union(ends).orderBy("part", "session_id").select("value").coalesce(1).write.text(path)


def read_injections(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Injection metadata: one row per capture out of a JSON object keyed by capture.

    With ``by_line`` every entry has a line of its own (``write_injections``) and a file of any
    length is read in splits; otherwise the object may be laid out in any way.
    """
    entry = "map<string,struct<injection_interval:array<double>,injection_data_str:string,injection_id:string>>"
    if by_line:
        lines = spark.read.text(path).where(~F.trim("value").isin("{", "}"))
        text = lines.select(F.concat(F.lit("{"), F.ltrim(F.trim("value"), F.lit(",")), F.lit("}")).alias("value"))
    else:
        text = spark.read.text(path, wholetext=True)
    return (
        text.select(F.explode(F.from_json("value", entry)).alias("session_id", "m"))
        .select(
            "session_id",
            F.get("m.injection_interval", F.lit(0)).alias("t_lo"),
            F.get("m.injection_interval", F.lit(1)).alias("t_hi"),
            F.col("m.injection_data_str").alias("pattern"),
            F.col("m.injection_id").alias("target"),
        )
    )


def payload_matches(payload: Column, pattern: Column) -> Column:
    """Equal length and equal digits, ``X`` standing for any digit."""
    return F.like(payload, F.translate(F.upper(pattern), "X", "_"))


def injected() -> Column:
    """Inside the capture's interval, on its identifier, with its payload."""
    target = F.upper(F.trim("target"))
    any_id = target.isNull() | target.isin("", ANY_ID)
    wanted = F.lpad(F.ltrim(F.regexp_replace(target, "^0X", ""), F.lit("0")), 3, "0")
    return F.coalesce(
        F.round("Timestamp", 6).between(F.col("t_lo"), F.col("t_hi"))
        & (any_id | (F.col("Arbitration_ID") == wanted))
        & payload_matches(F.col("payload"), F.col("pattern")),
        F.lit(False),
    )


def parse_road(lines: DataFrame, injections: DataFrame) -> DataFrame:
    """ROAD frames; the injection table has one row per capture and joins on it."""
    family = labels.road_family(F.col("session_id"))
    fields = with_fields(with_capture_facts(line_fields(lines, ROAD_LINE, 3), family))
    digits = F.col("digits")
    reason = reasons(
        ("malformed", ~F.col("well_formed")),
        ("bad_time", F.col("raw_time").isNull()),
        ("id_out_of_range", ~F.col("id_number").between(0, ROAD_LIMIT)),
        ("out_of_scope", F.col("id_number") > ROAD_SCOPE),
        ("bad_payload", (digits == 0) | (digits % 2 == 1) | (digits > 16)),
    )
    attack = F.when(F.col("family").isNotNull() & injected(), F.col("family")).otherwise("Normal")
    return canonical(
        fields.join(injections, "session_id", "left")
        .withColumns({"attack_type": attack, "reject_reason": reason})
        .select("*", *bytes_of_payload("payload"))
    )


def parse_mirgu(lines: DataFrame) -> DataFrame:
    """CAN-MIRGU frames; an empty payload is all zeros, labels come from the line flag."""
    stem = F.col("session_id")
    by_name = labels.mirgu_family(F.col("path"), stem)
    fields = with_fields(with_capture_facts(line_fields(lines, MIRGU_LINE, 4), by_name))
    digits, family = F.col("digits"), F.col("family")
    exact = labels.compound_family(stem, family, F.col("Arbitration_ID"), F.col("Timestamp"))
    reason = reasons(
        ("malformed", ~F.col("well_formed")),
        ("bad_time", F.col("raw_time").isNull()),
        ("id_out_of_range", ~F.col("id_number").between(0, MIRGU_LIMIT)),
        ("bad_payload", (digits % 2 == 1) | (digits > 16)),
        ("unknown_family", family.isNull()),
    )
    attack = F.when((family == "Normal") | (F.col("flag") == "0"), "Normal").otherwise(exact)
    return canonical(
        fields.withColumns({"attack_type": attack, "reject_reason": reason}).select(
            "*", *bytes_of_payload("payload")
        )
    )
