"""Finding capture files and choosing among them, as filters on file metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from canlake.functions.labels import mirgu_family

# What each dialect's files are called.
DIALECT_GLOBS = {
    "car_hacking_attack_defense": "*.csv",
    "hcrl_carhacking": "*.{csv,txt}",
    "road_raw": "*.log",
    "can_mirgu": "*.log",
    "ciciov2024": "*.csv",
    "survival_analysis": "*.txt",
}


def dialect_glob(dialect: str) -> str:
    if dialect not in DIALECT_GLOBS:
        raise ValueError(f"unknown dialect {dialect!r}; known: {sorted(DIALECT_GLOBS)}")
    return DIALECT_GLOBS[dialect]


def read_lines(spark: SparkSession, folder: str, dialect: str) -> DataFrame:
    """Every line below ``folder`` with its file and its place in the file.

    ``file_block`` is the byte offset of the split the line came from and
    ``line_key`` grows in line order inside a split, so big files stay splittable.
    Hidden files are left out by the file source.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", dialect_glob(dialect))
        .text(folder)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("file_block"),
            F.monotonically_increasing_id().alias("line_key"),
            "value",
        )
        .withColumn("session_id", file_stem(F.col("path")))
    )


# A path is taken apart on every line of its file, so without regular expressions.
def plain_path(path: Column) -> Column:
    """The path of a file's URL."""
    coded = path.contains("%") | path.contains("+")
    return F.when(coded, F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """The file name up to its last dot; a dot in front begins no extension."""
    name = file_name(path)
    stem = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    return F.when(stem > 0, F.substring(name, F.lit(1), stem)).otherwise(name)


def parent_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(F.substring_index(path, "/", -2), "/", 1)).otherwise("")


def glob_regex(pattern: str, across_folders: bool) -> str:
    """A shell pattern as a regular expression; ``*`` may or may not cross folders."""
    step = "." if across_folders else "[^/]"
    out, i = "", 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out += step + "*"
        elif char == "?":
            out += step
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = close
        else:
            out += re.escape(char)
        i += 1
    return out


def is_excluded(path: Column, root: str, patterns: list[str]) -> Column:
    """Whether a pattern matches the file name, the path below ``root``, or the path's end."""
    below = F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")
    hit = F.lit(False)
    for pattern in patterns:
        anywhere = glob_regex(pattern, across_folders=True)
        at_end = glob_regex(pattern, across_folders=False)
        hit = (
            hit
            | file_name(path).rlike(f"^(?s:{anywhere})$")
            | below.rlike(f"^(?s:{anywhere})$")
            | path.rlike(f"(^|/)(?s:{at_end})$")
        )
    return hit


def select_road(files: DataFrame, variant: str) -> DataFrame:
    """Attack captures of one ROAD experiment; ambient and accelerator captures are out."""
    if variant not in ("fabrication", "masquerade"):
        raise ValueError(f"ROAD has the variants 'fabrication' and 'masquerade', not {variant!r}")
    path, stem = F.col("path"), file_stem(F.col("path"))
    masquerade = stem.endswith("_masquerade")
    return files.where(
        (parent_folder(path) == "attacks")
        & ~stem.startswith("accelerator_attack_")
        & (masquerade if variant == "masquerade" else ~masquerade)
    )


def select_mirgu(files: DataFrame, variant: str) -> DataFrame:
    """The CAN-MIRGU corpus; ``real`` leaves the two constructed families out."""
    if variant not in ("real", "extended"):
        raise ValueError(f"CAN-MIRGU has the variants 'real' and 'extended', not {variant!r}")
    family = mirgu_family(F.col("path"), file_stem(F.col("path")))
    if variant == "extended":
        return files
    return files.where(~F.coalesce(family, F.lit("")).isin("Masquerade", "Suspension"))


def select_captures(files: DataFrame, dialect: str, variant: str | None) -> DataFrame:
    if dialect == "road_raw":
        return select_road(files, variant)
    if dialect == "can_mirgu":
        return select_mirgu(files, variant)
    return files
