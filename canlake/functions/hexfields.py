"""CAN identifiers and payload bytes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from canlake.schemas import BYTE_COLUMNS

PAD = "PAD"
VALUES = [f"value_{i}" for i in range(8)]


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pad_left(text: Column, width: int) -> Column:
    """Zero-fill on the left without ever shortening, unlike a bare ``lpad``."""
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def bare_hex(value: str | Column) -> Column:
    """Trimmed upper-case text without a leading ``0X``."""
    text = F.upper(F.trim(col(value)))
    return F.when(text.startswith("0X"), F.substring(text, F.lit(3), F.length(text))).otherwise(text)


def canonical_id(value: str | Column) -> Column:
    """Upper-case identifier without prefix, at least three digits long."""
    return pad_left(F.ltrim(bare_hex(value), F.lit("0")), 3)


def hex_value(value: str | Column) -> Column:
    """Hex text as an integer; null when the text is not hexadecimal."""
    text = bare_hex(value)
    return F.when(text.rlike("^[0-9A-F]+$"), F.conv(text, 16, 10).cast("int"))


def id_in_range(value: str | Column, top: int = 0x7FF) -> Column:
    """Whether an identifier is hexadecimal and at most ``top``."""
    text = F.ltrim(bare_hex(value), F.lit("0"))
    digits = len(f"{top:X}")
    short = F.when(F.length(text) <= digits, text)
    return bare_hex(value).rlike("^[0-9A-F]+$") & (
        F.when(text == "", 0).otherwise(F.coalesce(F.conv(short, 16, 10).cast("int"), F.lit(top + 1))) <= top
    )


def normal_byte(value: str | Column) -> Column:
    """Two upper-case digits, ``PAD`` for a missing byte, null when malformed.

    Blank text and a stray R/T flag count as missing.
    """
    text = bare_hex(value)
    short = F.regexp_replace(text, "^0+(?=.)", "")
    return (
        F.when(col(value).isNull() | (text == "") | text.isin("R", "T", PAD), PAD)
        .when(short.rlike("^[0-9A-F]{1,2}$"), F.lpad(short, 2, "0"))
    )


def byte_value(value: str | Column) -> Column:
    """Integer value of a byte column; null where the byte is missing."""
    return F.when(col(value) != PAD, F.conv(col(value), 16, 10).cast("int"))


def byte_or_zero(value: str | Column) -> Column:
    return F.coalesce(byte_value(value), F.lit(0))


def decoded(frames: DataFrame) -> DataFrame:
    """Adds ``id_number`` and ``value_0..7`` (null for a missing byte).

    The encodings use each number many times; parsed in a projection of their own
    the hex texts are parsed once.
    """
    return frames.withColumns(
        {
            "id_number": F.conv(bare_hex("Arbitration_ID"), 16, 10).cast("int"),
            **{value: byte_value(name) for value, name in zip(VALUES, BYTE_COLUMNS)},
        }
    )


def without_decoded(frames: DataFrame) -> DataFrame:
    return frames.drop("id_number", *VALUES)


def or_zero(value: str) -> Column:
    return F.coalesce(F.col(value), F.lit(0))


def bytes_of_payload(payload: str | Column) -> list[Column]:
    """Eight two-digit columns cut out of a 16-digit payload."""
    return [F.substring(col(payload), 2 * i + 1, 2).alias(name) for i, name in enumerate(BYTE_COLUMNS)]


def bytes_of_list(parts: Column) -> list[Column]:
    """Eight columns from an array of byte texts; missing entries become ``PAD``."""
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit(PAD)).alias(name) for i, name in enumerate(BYTE_COLUMNS)]
