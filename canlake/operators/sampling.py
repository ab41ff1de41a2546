"""Reproducible selections that need no random generator and no global shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, gcd

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canlake.operators.ordering import BLOCK_ROWS, join_groups, number_rows, rows_before
from canlake.storage import settle

STREAM_DOWNSAMPLE, STREAM_WINDOWS, STREAM_FRAMES = 0, 1, 2


ROUNDS = 3
#: A Lehmer generator; it draws the permutation's numbers on the driver.
MODULUS, FACTOR = 2**31 - 1, 48_271


@dataclass(frozen=True)
class Round:
    """``x -> (x * multiplier + shift) mod size``, then the numbers below ``fold`` once more with ``odd`` and ``turn``."""

    multiplier: int
    shift: int
    fold: int
    odd: int
    turn: int


def draw(number: int, seed: int, label: int, stream: int) -> int:
    """The ``number``-th draw for a seed, label and stream, from 1 to ``MODULUS`` - 1."""
    start = (seed * 7_919 + label * 104_729 + stream * 1_299_709) % (MODULUS - 1) + 1
    return start * pow(FACTOR, number + 8, MODULUS) % MODULUS


def permutation_of(size: int, seed: int, label: int, stream: int) -> list[Round]:
    """Rounds of a permutation of ``range(size)``; all their numbers depend on seed, label and stream.

    A round is two bijections: an affine map modulo the size, whose multiplier is the first
    without a common divisor from a drawn place on, and an affine map of the numbers below the
    greatest power of two, which breaks the regular steps of the first.
    """
    if size < 2:
        return []
    fold = 1 << (size.bit_length() - 1)
    rounds = []
    for i in range(ROUNDS):
        m, s, o, t = (draw(4 * i + j, seed, label, stream) for j in range(4))
        multiplier = size * (200_000 + m % 600_000) // 1_000_000
        while gcd(multiplier, size) != 1:
            multiplier += 1
        rounds.append(Round(multiplier, s * size // MODULUS, fold, 2 * (o * fold // MODULUS // 2) + 1, t * fold // MODULUS))
    return rounds


def permuted_number(x: int, size: int, rounds: list[Round]) -> int:
    """Where a permutation takes ``x``."""
    for r in rounds:
        x = (x * r.multiplier + r.shift) % size
        if x < r.fold:
            x = (x * r.odd + r.turn) % r.fold
    return x


def with_permuted(df: DataFrame, name: str, ordinal: str, label: str, sizes: dict[int, int], seed: int, stream: int) -> DataFrame:
    """Adds ``name``, the permuted rank of ``ordinal`` in its label; exact at any size.

    The rounds of each label are literals, and a fold over them binds every intermediate
    number once, so a filter on the rank stays small when it is pushed down.  Products stay in
    64 bits below 2^31 rows for each label and are decimals beyond.
    """
    whole = "bigint" if max(sizes.values(), default=0) < MODULUS else "decimal(19,0)"
    number = lambda n: F.lit(n).cast(whole)
    entries = []
    for value, size in sorted(sizes.items()):
        rounds = [
            F.struct(*(number(n).alias(key) for key, n in (("size", size), *vars(r).items())))
            for r in permutation_of(size, seed, value, stream)
        ]
        if rounds:
            entries += [F.lit(value).cast(df.schema[label].dataType), F.array(*rounds)]
    if not entries:
        return df.withColumn(name, F.col(ordinal).cast("bigint"))

    def step(x: Column, r: Column) -> Column:
        first = ((x * r["multiplier"] + r["shift"]) % r["size"]).cast(whole)
        turned = F.transform(F.array(first), lambda y: F.when(y < r["fold"], ((y * r["odd"] + r["turn"]) % r["fold"]).cast(whole)).otherwise(y))
        return F.get(turned, F.lit(0))

    rounds = F.try_element_at(F.create_map(*entries), F.col(label))
    start = F.col(ordinal).cast(whole)
    return df.withColumn(name, F.when(rounds.isNull(), start).otherwise(F.aggregate(rounds, start, step)).cast("bigint"))


def class_sizes(before: DataFrame, label: str) -> dict[int, int]:
    """Rows per class out of a settled block count; one row per class of the schema."""
    rows = before.groupBy(label).agg(F.first("total").alias("total")).collect()
    return {int(r[label]): int(r["total"]) for r in rows}


def with_class_ordinal(
    df: DataFrame, label: str, order: str, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, dict[int, int]]:
    """Adds ``ordinal`` (position in the class, file order); also returns class sizes."""
    before = settle(rows_before(df, [label], order, block_rows), "class-ordinals")
    return number_rows(df, before, [label], order, "ordinal", block_rows), class_sizes(before, label)


def balanced_target(sizes: dict[int, int], requested: int | None = None) -> int:
    smallest = min(sizes.values())
    if requested is not None and requested > smallest:
        raise ValueError(f"{requested} rows per class asked for, the smallest class has {smallest}: {sizes}")
    return smallest if requested is None else requested


def downsample_balanced(
    df: DataFrame, label: str, order: str, seed: int = 42, requested: int | None = None
) -> DataFrame:
    """The same number of rows from every class, picked by permuted rank (kept as ``rank``)."""
    ordered, sizes = with_class_ordinal(df, label, order)
    target = balanced_target(sizes, requested)
    return (
        with_permuted(ordered, "rank", "ordinal", label, sizes, seed, STREAM_DOWNSAMPLE)
        .where(F.col("rank") < target)
        .drop("ordinal", "ordinal_total")
    )


def apportion(sizes: dict[int, int], wanted: int | None) -> dict[int, int]:
    """Rows per class for a proportional sample: floors plus the largest remainders."""
    total = sum(sizes.values())
    if wanted is None or wanted >= total:
        return dict(sizes)
    shares = {label: size * wanted / total for label, size in sizes.items()}
    taken = {label: floor(share) for label, share in shares.items()}
    spare = wanted - sum(taken.values())
    by_fraction = sorted(shares, key=lambda label: (taken[label] - shares[label], label))
    for label in by_fraction[:spare]:
        taken[label] += 1
    return taken


def stratified_sample(df: DataFrame, label: str, order: str, wanted: int | None, seed: int = 42) -> DataFrame:
    """``wanted`` rows spread over the classes in proportion; all rows when there are fewer."""
    ordered, sizes = with_class_ordinal(df, label, order)
    quota = apportion(sizes, wanted)
    limits = F.create_map(*[F.lit(x) for pair in sorted(quota.items()) for x in pair])
    return (
        with_permuted(ordered, "rank", "ordinal", label, sizes, seed, STREAM_DOWNSAMPLE)
        .where(F.col("rank") < F.element_at(limits, F.col(label)))
        .drop("ordinal", "ordinal_total")
    )


def evenly_spaced(ordinal: Column, total: Column, points: int) -> Column:
    """Whether an ordinal is one of ``points`` evenly spaced indices of ``range(total)``.

    The indices are the truncated values of a linear spacing from 0 to total-1, so
    membership is arithmetic: look at the few steps that can land on this ordinal.
    """
    step = (total - 1) / F.lit(float(points - 1))
    near = F.ceil(ordinal / step)
    hits = F.exists(
        F.array(near - 1, near, near + 1),
        lambda j: (j >= 0) & (j < points - 1) & (F.floor(j * step) == ordinal),
    )
    return F.when(total <= points, F.lit(True)).otherwise(hits | (ordinal == total - 1))


EARLY_SLICES = 8


def capped_sample(df: DataFrame, groups: list[str], order: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per group: those with the smallest hash of seed and row.

    The cap is the feature: it bounds a scatter plot.  The hash range of a group is cut
    into slices of about ``cap`` rows.  Counting the first few slices tells in which one
    the cap is reached; only rows up to it are ranked, so a hot group is never sorted
    as a whole.  Should the counted slices not reach the cap, the group is ranked whole.
    """
    drawn = df.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string"))))
    sizes = settle(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    share = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sliced = join_groups(drawn, sizes, groups).withColumn(
        "_slice", F.floor(share * F.col("_n") / F.lit(float(cap))).cast("long")
    )
    so_far = F.sum("_c").over(W.partitionBy(*groups).orderBy("_slice"))
    reached = settle(
        sliced.where(F.col("_slice") < EARLY_SLICES)
        .groupBy(*groups, "_slice")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_sum", so_far)
        .groupBy(*groups)
        .agg(F.min(F.when(F.col("_sum") >= cap, F.col("_slice"))).alias("_last")),
        "reached-slices",
    )
    best = W.partitionBy(*groups).orderBy("_draw", order)
    return (
        join_groups(sliced, reached, groups, "left")
        .where(F.col("_last").isNull() | (F.col("_slice") <= F.col("_last")))
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= cap)
        .drop("_draw", "_n", "_slice", "_last", "_rank")
    )
