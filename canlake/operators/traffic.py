"""Exploratory traffic statistics: identifiers, byte behaviour, attack segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canlake.functions.encodings import hertz, id_value
from canlake.functions.hexfields import VALUES, decoded
from canlake.functions.labels import is_benign
from canlake.operators.ordering import with_ordinal
from canlake.schemas import BYTE_COLUMNS, LabelSchema

# Fixed values of the byte classification and of the swarm layout.
MONOTONE_SHARE = 0.75
FEW_VALUES = 8
SWARM_WIDTH = 0.42
SWARM_BINS = 100
SWARM_STEP = 0.055


def rows_per_attack_type(df: DataFrame) -> DataFrame:
    """Rows and percentage (2 decimals) per label; the total runs over one row per label."""
    counts = df.groupBy("attack_type").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(W.partitionBy())
    return counts.select("attack_type", "rows", F.round(F.col("rows") / total * 100, 2).alias("percentage"))


def ids_per_attack_type(df: DataFrame) -> DataFrame:
    """Distinct identifiers per label: deduplicate pairs first, then count."""
    pairs = df.groupBy("attack_type", "Arbitration_ID").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("attack_type").agg(F.count(F.lit(1)).alias("ids"))


def classes_per_id(df: DataFrame) -> DataFrame:
    """Labels seen with each identifier, in one text; pairs are deduplicated first."""
    pairs = df.select("Arbitration_ID", "attack_type").distinct()
    return pairs.groupBy("Arbitration_ID").agg(
        F.array_join(F.array_sort(F.collect_set("attack_type")), ", ").alias("classes")
    )


def frequency_per_id(df: DataFrame) -> DataFrame:
    """Mean gap per identifier over positive gaps, in hertz and in the per-1000 figure."""
    return (
        df.where("Delta_Id > 0")
        .groupBy("Arbitration_ID")
        .agg(F.avg("Delta_Id").alias("mean_gap"))
        .select(
            "Arbitration_ID",
            "mean_gap",
            hertz(F.col("mean_gap")).alias("mean_freq_hz"),
            (F.lit(1000.0) / F.col("mean_gap")).alias("mean_freq_x1000"),
        )
    )


def frames_per_id(df: DataFrame) -> DataFrame:
    return df.groupBy("Arbitration_ID").agg(F.count(F.lit(1)).alias("frames"), F.max("DLC").alias("max_dlc"))


def busiest_ids(df: DataFrame, top: int) -> DataFrame:
    """The ``top`` identifiers by frames, shown in identifier order."""
    return frames_per_id(df).orderBy(F.desc("frames"), "Arbitration_ID").limit(top).orderBy("Arbitration_ID")


def attack_only_ids(df: DataFrame, schema: LabelSchema) -> DataFrame:
    """Identifiers seen in attack traffic and never in benign traffic, by number."""
    kinds = df.groupBy("Arbitration_ID", is_benign("Class", schema).alias("benign")).agg(F.count(F.lit(1)).alias("n"))
    attack = kinds.where("NOT benign").select("Arbitration_ID")
    benign = kinds.where("benign").select("Arbitration_ID")
    return (
        attack.join(benign, "Arbitration_ID", "left_anti")
        .withColumn("id_number", id_value())
        .orderBy("id_number")
    )


def present_classes(df: DataFrame) -> DataFrame:
    """Labels present, and whether they run from 0 without a gap."""
    labels = df.groupBy("Class").agg(F.count(F.lit(1)).alias("n"))
    return labels.agg(
        F.array_sort(F.collect_list("Class")).alias("labels"),
        (F.max("Class") + 1 == F.count(F.lit(1))).alias("contiguous"),
    )


def only_benign(df: DataFrame, schema: LabelSchema, negate: bool = False) -> DataFrame:
    keep = is_benign("Class", schema)
    return df.where(~keep if negate else keep)


def slice_of(df: DataFrame, session: str, can_id: str, t_from: float, t_to: float) -> DataFrame:
    """One identifier of one session within a closed time range, in time order."""
    return df.where(
        (F.col("session_id") == session)
        & (F.col("Arbitration_ID") == can_id)
        & F.col("Timestamp").between(t_from, t_to)
    ).orderBy("Timestamp", "row_id")


def active_bytes(df: DataFrame, groups: list[str], order: str = "pos") -> DataFrame:
    """Per group, the byte columns its first frame uses."""
    first = df.groupBy(*groups).agg(F.min_by("DLC", order).alias("dlc"))
    names = F.array(*[F.lit(n) for n in BYTE_COLUMNS])
    return first.select(*groups, F.slice(names, F.lit(1), F.col("dlc")).alias("active"))


def byte_patterns(laid_out: DataFrame) -> DataFrame:
    """Pattern of each (identifier, byte): constant, sawtooth, random, polynomial, no byte.

    Differences are between consecutive values of the identifier in table order.
    Partitions of the layout are the blocks; the last known values before a block
    come in as one carry row, so a dominant identifier is worked on block by block.
    """
    names = VALUES
    values = decoded(laid_out).select("Arbitration_ID", "DLC", "part", "slot", *names, F.lit(True).alias("core"))
    ahead = W.partitionBy("Arbitration_ID").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    lasts = values.groupBy("Arbitration_ID", "part").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("slot"))).alias(n) for n in names]
    )
    carries = lasts.select(
        "Arbitration_ID", "part", F.lit(-1).cast("long").alias("slot"), F.lit(False).alias("core"),
        *[F.last(n, ignorenulls=True).over(ahead).alias(n) for n in names],
    )
    inside = W.partitionBy("part", "Arbitration_ID").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    stepped = (
        values.unionByName(carries, allowMissingColumns=True)
        .select(
            "*",
            *[F.last(n, ignorenulls=True).over(inside).alias(f"p{i}") for i, n in enumerate(names)],
        )
        .where("core")
    )
    figures = [F.max("DLC").alias("dlc")]
    for i, name in enumerate(names):
        change = F.col(name) - F.col(f"p{i}")
        figures += [
            F.count(name).alias(f"n{i}"),
            *[value_bits(name, word).alias(f"u{i}_{word}") for word in range(4)],
            F.count(change).alias(f"d{i}"),
            F.count_if(change > 0).alias(f"up{i}"),
            F.count_if(change < 0).alias(f"down{i}"),
        ]
    per_id = stepped.groupBy("Arbitration_ID").agg(*figures)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("byte"),
                pattern_name(
                    F.lit(i) >= F.col("dlc"), F.col(f"n{i}"), sum(F.bit_count(f"u{i}_{w}") for w in range(4)), F.col(f"d{i}"),
                    F.col(f"up{i}"), F.col(f"down{i}"),
                ).alias("pattern"),
            )
            for i in range(8)
        ]
    )
    return per_id.select("Arbitration_ID", F.inline(rows))


def value_bits(name: str, word: int) -> Column:
    """Which of the byte values ``64 * word`` to ``64 * word + 63`` occur, as 64 bits."""
    mine = F.shiftright(name, 6) == word
    return F.bit_or(F.when(mine, F.expr(f"shiftleft(1L, {name} & 63)")).otherwise(F.lit(0).cast("long")))


def pattern_name(unused: Column, n: Column, distinct: Column, steps: Column, up: Column, down: Column) -> Column:
    return (
        F.when(unused | (n == 0), "No byte")
        .when((distinct == 1) | (steps == 0), "Constant")
        .when((F.greatest(up, down) / steps > MONOTONE_SHARE) & (distinct > FEW_VALUES), "Sawtooth")
        .when(distinct <= FEW_VALUES, "Random")
        .otherwise("Polynomial")
    )


def attack_segments(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Maximal runs of consecutive frames of one class, in ms since the session start.

    A run without extent is drawn 0.01 ms long.
    """
    run = with_ordinal(
        frames.select("session_id", "Class", "pos", "Timestamp"), ["session_id", "Class"], "pos",
        counts_label="class-runs",
    ).withColumn("island", F.col("pos") - F.col("ordinal"))
    spans = run.groupBy("session_id", "Class", "island").agg(
        F.min("pos").alias("first_pos"),
        F.count(F.lit(1)).alias("frames"),
        F.min("Timestamp").alias("t_start"),
        F.max("Timestamp").alias("t_end"),
    )
    start = (F.col("t_start") - F.col("t_first")) * 1000
    end = (F.col("t_end") - F.col("t_first")) * 1000
    return spans.join(sessions.select("session_id", "t_first"), "session_id").select(
        "session_id", "Class", "first_pos", "frames",
        start.alias("start_ms"),
        F.when(start == end, start + 0.01).otherwise(end).alias("end_ms"),
    )


def swarm_offsets(points: DataFrame, groups: list[str], value: str, order: str) -> DataFrame:
    """Horizontal offsets that spread equal values around 0 inside each group.

    ``points`` must already be capped per group (``sampling.capped_sample``), which
    bounds every window here.
    """
    whole = W.partitionBy(*groups)
    share = (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    binned = (
        points.withColumn("_low", F.min(value).over(whole))
        .withColumn("_high", F.max(value).over(whole))
        .withColumn(
            "bin",
            F.when(F.col("_high") == F.col("_low"), F.lit(0)).otherwise(
                F.least(F.greatest(F.floor(share * SWARM_BINS), F.lit(0)), F.lit(SWARM_BINS - 1))
            ).cast("int"),
        )
    )
    in_bin = W.partitionBy(*groups, "bin")
    count = F.count(F.lit(1)).over(in_bin)
    rank = F.row_number().over(in_bin.orderBy(order)) - 1
    half = (F.col("_count") - 1) / 2
    step = F.least(F.lit(SWARM_STEP), F.lit(SWARM_WIDTH) / F.greatest(F.lit(1.0), half))
    offset = (F.col("_rank") - half) * step
    return (
        binned.withColumn("_count", count)
        .withColumn("_rank", rank)
        .withColumn(
            "offset",
            F.when(F.col("_count") == 1, F.lit(0.0)).otherwise(
                F.least(F.greatest(offset, F.lit(-SWARM_WIDTH)), F.lit(SWARM_WIDTH))
            ),
        )
        .drop("_low", "_high", "_count", "_rank")
    )
