"""Frame encodings fed to the detectors, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from canlake.functions.hexfields import PAD, VALUES, bare_hex, col, or_zero, pad_left
from canlake.schemas import BYTE_COLUMNS

# Token vocabulary of the next-identifier detector.
ID_TOKEN_OFFSET = 256
VOID_TOKEN = 2304
MASK_TOKEN = 2305
VOCABULARY = 2306

# Encodings that read ``id_number`` or ``value_0..7`` need ``hexfields.decoded`` first.
ID = "id_number"


def id_value(value: str | Column = "Arbitration_ID") -> Column:
    """Number of a well-formed identifier, with or without ``0x``."""
    return F.conv(F.substring_index(F.upper(F.trim(col(value))), "X", -1), 16, 10).cast("int")


def bits(number: Column, width: int) -> list[Column]:
    """The low ``width`` bits, most significant first."""
    return [F.shiftright(number, width - 1 - i).bitwiseAND(1) for i in range(width)]


def id_bits(width: int = 11) -> Column:
    return F.array(*bits(F.col(ID), width))


def numeric_values() -> list[Column]:
    """DLC and the eight byte values: the part of the frame vector that is normalised."""
    return [F.col("DLC").cast("double"), *[or_zero(v).cast("double") for v in VALUES]]


def frame_vector(width: int = 11) -> Column:
    """Identifier bits, DLC and bytes in one array of doubles (20 values for 11 bits)."""
    return F.array(*[b.cast("double") for b in bits(F.col(ID), width)], *numeric_values())


def id_nibbles_and_bytes() -> Column:
    """Four identifier nibbles (of the last four digits), then the eight byte values."""
    nibbles = [F.shiftright(F.col(ID), s).bitwiseAND(15) for s in (12, 8, 4, 0)]
    return F.array(*nibbles, *[or_zero(v) for v in VALUES])


def nibble_tokens() -> Column:
    """Three identifier nibbles, then high and low nibble of every byte (19 tokens)."""
    number = F.col(ID).bitwiseAND(0x7FF)
    head = [F.shiftright(number, s).bitwiseAND(15) for s in (8, 4, 0)]
    tail = []
    for value in VALUES:
        tail += [F.shiftright(or_zero(value), 4).bitwiseAND(15), or_zero(value).bitwiseAND(15)]
    return F.array(*head, *tail)


def payload_bits() -> Column:
    """8 x 8 bit matrix of the payload, most significant bit first."""
    return F.array(*[F.array(*bits(or_zero(v), 8)) for v in VALUES])


def nibbles_of_bits(matrix: str) -> Column:
    """Sixteen nibbles out of a column holding an 8 x 8 bit matrix."""
    out = []
    for row in range(8):
        cells = [F.get(F.get(F.col(matrix), F.lit(row)), F.lit(i)) for i in range(8)]
        out += [a * 8 + b * 4 + c * 2 + d for a, b, c, d in (cells[:4], cells[4:])]
    return F.array(*out)


def id_token(value: str | Column = "Arbitration_ID") -> Column:
    """Identifier token; an identifier above 11 bits fails the job."""
    number = id_value(value)
    problem = F.concat(F.lit("identifier above 0x7FF: "), col(value))
    return F.when(number <= 0x7FF, number + ID_TOKEN_OFFSET).otherwise(F.raise_error(problem).cast("int"))


def byte_token(value: str | Column) -> Column:
    text = bare_hex(value)
    missing = col(value).isNull() | text.isin("", PAD, "NONE", "R", "T")
    number = F.when(~missing, F.conv(text, 16, 10).cast("int"))
    problem = F.concat(F.lit("byte above 0xFF: "), col(value))
    return (
        F.when(missing, VOID_TOKEN)
        .when(number <= 0xFF, number)
        .otherwise(F.raise_error(problem).cast("int"))
    )


def payload_tokens() -> Column:
    return F.array(*[byte_token(name) for name in BYTE_COLUMNS])


def frame_text() -> Column:
    """``"ID DLC B0 .. B7"`` with a hexadecimal DLC."""
    return F.concat_ws(
        " ",
        bare_hex("Arbitration_ID"),
        F.hex(F.col("DLC").cast("long")),
        *[F.upper(F.col(name)) for name in BYTE_COLUMNS],
    )


def sinusoids(angle_base: Column, width: int) -> Column:
    """Interleaved sine and cosine of ``angle_base / 10000^(2i/width)``."""
    out = []
    for i in range(0, width, 2):
        angle = angle_base / F.lit(float(10000.0 ** (i / width)))
        out += [F.sin(angle), F.cos(angle)]
    return F.array(*out)


def smoothed_position(index: Column, elapsed: Column, alpha: float = 1e-7) -> Column:
    """Index in the window plus ``log2(elapsed/alpha + 1)``; the first frame keeps index 0."""
    smooth = F.log2(F.greatest(elapsed / F.lit(alpha), F.lit(0.0)) + F.lit(1.0))
    return F.when(index == 0, F.lit(0.0)).otherwise(index + smooth)


def absolute_time_index(timestamp: str | Column = "Timestamp", granularity: float = 1e-8, positions: int = 10000) -> Column:
    """Row of the sinusoid table for an absolute time; both roundings are half-even."""
    ticks = F.rint(col(timestamp) / F.lit(granularity)) + F.lit(1.0)
    index = F.rint(F.log2(F.greatest(ticks, F.lit(1.0)))).cast("int")
    return F.least(F.greatest(index, F.lit(0)), F.lit(positions - 1))


def hertz(mean_gap: Column) -> Column:
    return F.lit(1.0) / mean_gap


def elapsed_ms(timestamp: Column, origin: Column) -> Column:
    return (timestamp - origin) * F.lit(1000.0)


def byte_lane(index: int) -> Column:
    """Byte value scaled into the unit lane ``[index, index + 1]``; null for a missing byte."""
    return F.lit(float(index)) + F.col(VALUES[index]) / F.lit(255.0)
