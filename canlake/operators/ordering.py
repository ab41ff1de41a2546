"""Positions and ordered neighbourhoods that survive one very large session.

A capture session can hold a third of all frames, so nothing here lets a window
run over a whole session.  ``lay_out`` orders the frames with a range shuffle on
the full (session, time, row) key, which cuts a big session into many partitions,
and numbers them from partition counts.  Everything later addresses frames by
position, in blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from canlake.storage import scratch_path, settle

BLOCK_ROWS = 1 << 18
UNIT_BYTES = 32 << 20  # of stored input for one range partition
BROADCAST_RUNS = 1_000_000  # about 100 MB of (session, partition) bookkeeping
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in its low 33 bits


@dataclass(frozen=True)
class Layout:
    """A frame table on disk in (session, time, row) order, with its bookkeeping."""

    spark: SparkSession
    path: str
    n_runs: int

    @property
    def runs(self) -> DataFrame:
        """One row per (session, partition): how many frames precede it in the session."""
        return self.spark.read.parquet(f"{self.path}/runs")

    @property
    def frames(self) -> DataFrame:
        """Stored columns plus ``pos`` (0-based in the session), ``part`` and ``slot``.

        ``slot`` grows in table order, ``part`` is its range partition.  The bookkeeping
        is broadcast after a check of its counted size; a larger one is joined on
        (session, partition), which no single session dominates.
        """
        rows = self.spark.read.parquet(f"{self.path}/rows").withColumn(
            "part", F.shiftright("slot", _LOCAL_BITS)
        )
        runs = self.bounded(
            self.runs.select(F.col("session_id").alias("_s"), F.col("part").alias("_p"), "first_slot", "before")
        )
        return (
            rows.join(runs, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
            .withColumn("pos", F.col("slot") - F.col("first_slot") + F.col("before"))
            .drop("_s", "_p", "first_slot", "before")
        )

    @property
    def sessions(self) -> DataFrame:
        """One row per session: frame count, first and last time; never more than runs."""
        return self.bounded(
            self.runs.groupBy("session_id").agg(
                F.sum("n").alias("n_frames"),
                F.min("t_min").alias("t_first"),
                F.max("t_max").alias("t_last"),
            )
        )

    def bounded(self, bookkeeping: DataFrame) -> DataFrame:
        """Broadcast if the counted bookkeeping is small, else leave the join to Spark."""
        return F.broadcast(bookkeeping) if self.n_runs <= BROADCAST_RUNS else bookkeeping


def session_order(df: DataFrame) -> list[str]:
    """Canonical order: by time where there is one, ``row_id`` breaking ties."""
    return ["session_id", "Timestamp", "row_id"] if "Timestamp" in df.columns else ["session_id", "row_id"]


UNKNOWN_BYTES = 1 << 60  # Spark's estimate where it knows nothing is larger


def input_bytes(df: DataFrame) -> int:
    """Size of the tables a plan reads, from their files; runs no job.  Sources of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < UNKNOWN_BYTES)


def work_units(df: DataFrame, unit_bytes: int = UNIT_BYTES) -> int:
    """How many range partitions keep a partition at about ``unit_bytes`` of input."""
    return max(1, -(-input_bytes(df) // unit_bytes))


def range_partitioned(df: DataFrame, *order: str, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Range partitions by ``order``: as many as the input asks for, never fewer than the session is set to.

    So the unit of later work, one range partition, does not grow with the table.
    """
    wanted = work_units(df, unit_bytes)
    if wanted <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartitionByRange(*order)
    return df.repartitionByRange(wanted, *order)


def lay_out(df: DataFrame, unit_bytes: int = UNIT_BYTES) -> Layout:
    """Order a frame table once and keep it in the shared folder.

    One range shuffle and one write; the numbering afterwards reads a table of
    (sessions + partitions) rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "layout")
    order = session_order(df)
    (
        range_partitioned(df, *order, unit_bytes=unit_bytes)
        .sortWithinPartitions(*order)
        .withColumn("slot", F.monotonically_increasing_id())
        .write.option("compression", "zstd")
        .parquet(f"{path}/rows")
    )
    time = F.col("Timestamp") if "Timestamp" in df.columns else F.lit(None).cast("double")
    earlier = W.partitionBy("session_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    (
        spark.read.parquet(f"{path}/rows")
        .groupBy("session_id", F.shiftright("slot", _LOCAL_BITS).alias("part"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("slot").alias("first_slot"),
            F.min(time).alias("t_min"),
            F.max(time).alias("t_max"),
        )
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .write.parquet(f"{path}/runs")
    )
    return Layout(spark, path, spark.read.parquet(f"{path}/runs").count())


def block_of(position: str | Column, block_rows: int = BLOCK_ROWS) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(block_rows)).cast("long")


def with_halo(
    df: DataFrame, before: int = 0, after: int = 0, position: str = "pos", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Copy block edges into the neighbour block, adding ``block`` and ``core``.

    A window partitioned by (session, block) then sees ``before`` rows ahead of
    and ``after`` rows behind every core row; keep the core rows afterwards.
    """
    if max(before, after) > block_rows:
        raise ValueError(f"a halo of {max(before, after)} rows does not fit blocks of {block_rows}")
    own = block_of(position, block_rows)
    inside = F.col(position) - own * block_rows
    to_next, to_previous = inside >= block_rows - before, (inside < after) & (own > 0)
    copies = (
        F.when(to_next & to_previous, F.array(own, own + 1, own - 1))
        .when(to_next, F.array(own, own + 1))
        .when(to_previous, F.array(own, own - 1))
        .otherwise(F.array(own))
    )
    return df.withColumn("block", F.explode(copies)).withColumn("core", F.col("block") == own)


def with_ordinal(
    df: DataFrame,
    groups: list[str],
    order: str,
    name: str = "ordinal",
    block_rows: int = BLOCK_ROWS,
    counts_label: str = "ordinals",
) -> DataFrame:
    """0-based ordinal of each row in its group, along the unique integer ``order``.

    Two passes: rows per (group, block of ``order``) are counted with map-side
    combining and summed up along the blocks; then rows are numbered inside each
    (group, block).  Blocks of a unique integer hold at most ``block_rows`` rows,
    so a group that covers most of the table is still spread over all tasks.
    """
    before = settle(rows_before(df, groups, order, block_rows), counts_label)
    return number_rows(df, before, groups, order, name, block_rows)


def rows_before(df: DataFrame, groups: list[str], order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per (group, block): its rows ``n``, the rows ``before`` it, and the group's ``total``."""
    along = W.partitionBy(*groups).orderBy("block")
    return (
        df.groupBy(*groups, block_of(order, block_rows).alias("block"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
        .withColumn("total", F.sum("n").over(W.partitionBy(*groups)))
    )


def number_rows(
    df: DataFrame, before: DataFrame, groups: list[str], order: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Second pass of ``with_ordinal``; also adds ``<name>_total``, the group size."""
    keys = [*groups, "block"]
    inside = W.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("block", block_of(order, block_rows)).withColumn(
        "_inside", F.row_number().over(inside) - 1
    )
    return (
        join_groups(numbered, before.select(*keys, "before", "total"), keys)
        .withColumn(name, (F.col("_inside") + F.col("before")).cast("long"))
        .withColumnRenamed("total", f"{name}_total")
        .drop("_inside", "before", "block")
    )


def join_groups(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Adds per-group facts to rows; a null key is a group like any other."""
    renamed = facts.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return df.join(renamed, condition, how).drop(*[f"_{k}" for k in keys])


def in_canonical_order(df: DataFrame) -> DataFrame:
    """The table in (session, time, row) order, for export."""
    return df.orderBy(*session_order(df))
