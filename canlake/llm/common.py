"""Steps that several operators take: running totals, connected components, row keys."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canlake.storage import settle

WORD = r"[^\x20\x09-\x0D]+"


def reach_workers(spark) -> None:
    """Lets Python workers import this package from where the driver has it.

    On a cluster whose executors do not have that folder, ship the package with
    ``--py-files``; a folder that is not there does no harm.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of ``keys`` in which null equals null."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def free_name(taken: list[str], wished: str) -> str:
    """``wished``, or with underscores before it until no column of ``taken`` has that name in any case."""
    known = {name.lower() for name in taken}
    while wished.lower() in known:
        wished = f"_{wished}"
    return wished


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, before: str, label: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the earlier rows of the same group.

    Rows are range-partitioned on (group, order) and written, so a group of any size is
    cut into bounded runs; a run's offset comes from the totals of the runs before it.
    ``order`` must end in a unique column.  ``df`` is read twice (range bounds): settle
    it first when it is costly.
    """
    run, row, total, offset, inside = (free_name(df.columns, name) for name in ("run", "row", "total", "offset", "inside"))
    laid = settle(
        df.repartitionByRange(partitions(df), *group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn(run, F.spark_partition_id())
        .withColumn(row, F.monotonically_increasing_id()),
        f"{label}-laid",
    )
    totals = settle(laid.groupBy(run, *group).agg(F.sum(value).alias(total)), f"{label}-totals")
    earlier = Window.partitionBy(*group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(run, *group, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(offset))
    within = Window.partitionBy(run, *group).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    inner = laid.withColumn(inside, F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inner.join(offsets, same(inner, offsets, [run, *group]), "left")
    kept = [inner[c] for c in df.columns]
    return joined.select(*kept, (inner[inside] + offsets[offset]).alias(before))


def to_roots(move: DataFrame, label: str) -> DataFrame:
    """Follows (node, to) to the roots, nodes that point to themselves, by doubling."""
    while True:
        after = move.select(F.col("node").alias("to"), F.col("to").alias("next"))
        doubled = move.join(after, "to").select("node", "to", "next")
        if doubled.where("to <> next").isEmpty():
            return move
        move = settle(doubled.select("node", F.col("next").alias("to")), f"{label}-jumps")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Every node moves to its smallest neighbour; the moves make trees, and pointers are
    doubled until each node points to its tree's root.  Then the graph is contracted to
    the roots, until no edge is left, and the moves are followed back.  A contraction at least
    halves the nodes and doubling takes the logarithm of a tree's depth, so a long chain
    takes few rounds.  Each round is written, so the lineage
    stays short; a hub's edges meet only in joins, which adaptive execution splits, and
    in partial minima.
    """
    current = settle(edges.select("a", "b").where("a <> b").distinct(), f"{label}-edges")
    moves = []
    while not current.isEmpty():
        ends = current.select(F.col("a").alias("node"), F.col("b").alias("other")).union(current.select("b", "a"))
        move = settle(
            ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")),
            f"{label}-moves",
        )
        move = to_roots(move, label)
        moves.append(move)
        one = current.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        two = one.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select("x", "y")
        current = settle(
            two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"{label}-edges",
        )
    spark = edges.sparkSession
    if not moves:
        return spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    found = moves[-1].select("node", F.col("to").alias("component"))
    for move in reversed(moves[:-1]):
        after = found.select(F.col("node").alias("to"), "component")
        found = settle(
            move.join(after, "to", "left").select("node", F.coalesce("component", "to").alias("component")),
            f"{label}-labels",
        )
    return found
