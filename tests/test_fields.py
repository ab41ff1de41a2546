"""Identifier, byte and encoding expressions on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from canlake.functions import encodings as enc, hexfields as hx


def evaluate(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression).first()[0]


@pytest.mark.parametrize("text,want", [("00", 0), ("FF", 255), ("7B", 123), ("PAD", 0), (None, 0)])
def test_byte_or_zero(spark, text, want):
    assert evaluate(spark, text, hx.byte_or_zero("x")) == want


@pytest.mark.parametrize("text,want", [("000", 0), ("7FF", 2047), ("0354", 852), ("0x1a", 26), ("zz", None), ("", None)])
def test_hex_value(spark, text, want):
    assert evaluate(spark, text, hx.hex_value("x")) == want


@pytest.mark.parametrize(
    "text,want", [(" 0x0a3 ", "0A3"), ("0", "000"), ("ABCD", "ABCD"), ("0316", "316"), ("7", "007")]
)
def test_canonical_id_never_shortens(spark, text, want):
    assert evaluate(spark, text, hx.canonical_id("x")) == want


@pytest.mark.parametrize(
    "text,top,want", [("7FF", 0x7FF, True), ("800", 0x7FF, False), ("00000700", 0x700, True), ("701", 0x700, False), ("xyz", 0x7FF, False), ("0", 1, True), ("12345", 0x7FF, False)]
)
def test_id_range(spark, text, top, want):
    assert evaluate(spark, text, hx.id_in_range("x", top)) is want


@pytest.mark.parametrize(
    "text,want", [(None, "PAD"), ("  ", "PAD"), ("r", "PAD"), ("T", "PAD"), ("a", "0A"), ("0x0f", "0F"), ("100", None), ("00ff", "FF"), ("g1", None)]
)
def test_normal_byte(spark, text, want):
    assert evaluate(spark, text, hx.normal_byte("x")) == want


@pytest.mark.parametrize("text,want", [("000", 256), ("0X7FF", 2303), ("2C0", 0x2C0 + 256)])
def test_id_token(spark, text, want):
    assert evaluate(spark, text, enc.id_token("x")) == want


def test_id_token_rejects_29_bit_identifiers(spark):
    with pytest.raises(Exception, match="above 0x7FF"):
        evaluate(spark, "800", enc.id_token("x"))


@pytest.mark.parametrize("text,want", [("00", 0), ("FF", 255), ("PAD", 2304), (None, 2304), (" ", 2304), ("R", 2304)])
def test_byte_token(spark, text, want):
    assert evaluate(spark, text, enc.byte_token("x")) == want


def test_byte_token_rejects_wide_bytes(spark):
    with pytest.raises(Exception, match="above 0xFF"):
        evaluate(spark, "100", enc.byte_token("x"))


def test_vocabulary():
    assert (enc.MASK_TOKEN, enc.VOCABULARY) == (2305, 2306)


def test_bits_become_nibbles(spark, make_frames):
    frame = hx.decoded(make_frames([(0, "s", 0, "123", 0, 8, ["2A", "F0", "07", "FF", "01", "10", "80", "PAD"])]))
    row = frame.select(enc.payload_bits().alias("m")).select("m", enc.nibbles_of_bits("m").alias("n")).first()
    assert list(row["n"]) == [2, 10, 15, 0, 0, 7, 15, 15, 0, 1, 1, 0, 8, 0, 0, 0]
    assert [list(r) for r in row["m"]][0] == [0, 0, 1, 0, 1, 0, 1, 0]


def test_frame_vector_has_twenty_values(spark, make_frames):
    vector = hx.decoded(make_frames([(0, "s", 0, "401", 0, 3, ["01", "02", "FF"] + ["PAD"] * 5)])).select(enc.frame_vector()).first()[0]
    assert list(vector) == [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 3, 1, 2, 255, 0, 0, 0, 0, 0]


def test_frame_text(spark, make_frames):
    assert make_frames([(0, "s", 0, "0x2c0", 0)]).select(enc.frame_text()).first()[0] == "2C0 8 01 02 03 04 05 06 07 08"


def test_sinusoids_at_zero(spark):
    waves = spark.range(1).select(enc.sinusoids(F.lit(0.0), 10)).first()[0]
    assert list(waves[0::2]) == [0.0] * 5 and list(waves[1::2]) == [1.0] * 5


def test_smoothed_positions(spark):
    times = [10, 10.002, 10.005, 10.009, 10.015]
    rows = spark.createDataFrame([(i, t - 10.0) for i, t in enumerate(times)], "i int, dt double")
    got = [r[0] for r in rows.select("i", enc.smoothed_position(F.col("i"), F.col("dt")).alias("p")).orderBy("i").select("p").collect()]
    want = [0.0] + [i + math.log2((t - 10.0) / 1e-7 + 1) for i, t in enumerate(times) if i]
    assert got == pytest.approx(want, abs=1e-12)


def test_absolute_time_index_rounds_half_even(spark):
    # round(2.5e-8 / 1e-8) is 2, so the index is round(log2(3)) = 2; time 0 gives 0
    assert evaluate(spark, 2.5e-8, enc.absolute_time_index("x"), "double") == 2
    assert evaluate(spark, 0.0, enc.absolute_time_index("x"), "double") == 0
    assert evaluate(spark, 1e20, enc.absolute_time_index("x", positions=50), "double") == 49
