"""Sharding along a Hilbert curve. DataFrame functions only.

Several columns are quantised to ``BITS`` bits each so that every cell of a dimension
holds a near-equal number of rows, the cell tuple is turned into its index on the
Hilbert curve, and rows in the order (index, size, doc_id, row key) are cut into runs of
equal counts.  A shard is thus compact in every dimension, and file statistics prune on
any of them.  The law is ``rows``: shard sizes differ by one row at most.

The index follows Hamilton, "Compact Hilbert Indices" (2006): at each level the cell bits
are rotated and reflected into the current frame, ranked by the inverse Gray code, and
the frame (entry, direction) is updated.

Nulls of a dimension form a cell before all values; null and empty texts have size 1;
rows with equal doc_id or text are placed separately (equal texts may part, as the law
counts rows); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm.common import free_name, partitions, running_total, table
from canlake.storage import settle

BITS = 8
SHARDS = 8


def _tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """Inverse Gray code, entry point and direction for each cell of one level."""
    n = 1 << dims
    inverse = [0] * n
    for w in range(n):
        inverse[w ^ (w >> 1)] = w

    def ones(w: int) -> int:  # trailing ones
        return (~w & (w + 1)).bit_length() - 1

    entry = [0] + [(2 * ((w - 1) // 2)) ^ (2 * ((w - 1) // 2) >> 1) for w in range(1, n)]
    direction = [0] + [(ones(w - 1) if w % 2 == 0 else ones(w)) % dims for w in range(1, n)]
    return inverse, entry, direction


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index of a point on the Hilbert curve of ``len(cells)`` dimensions (at most 63 bits)."""
    dims = len(cells)
    inverse, entry, direction = ("array(" + ",".join(map(str, t)) + ")" for t in _tables(dims))
    mask = (1 << dims) - 1

    def step(state: Column, level: Column) -> Column:
        label = F.lit(0)
        for d, cell in enumerate(cells):
            label = label.bitwiseOR(F.shiftleft(F.call_function("shiftright", cell.cast("int"), level).bitwiseAND(F.lit(1)), d))
        by = (state["d"] + 1) % dims
        seen = label.bitwiseXOR(state["e"])
        turned = F.call_function("shiftright", seen, by).bitwiseOR(F.call_function("shiftleft", seen, F.lit(dims) - by)).bitwiseAND(F.lit(mask))
        rank = F.element_at(F.expr(inverse), turned + 1)
        entered = F.element_at(F.expr(entry), rank + 1)
        back = F.call_function("shiftleft", entered, by).bitwiseOR(F.call_function("shiftright", entered, F.lit(dims) - by)).bitwiseAND(F.lit(mask))
        return F.struct(
            F.shiftleft(state["h"], dims).bitwiseOR(rank.cast("long")).alias("h"),
            state["e"].bitwiseXOR(back).alias("e"),
            ((state["d"] + F.element_at(F.expr(direction), rank + 1) + 1) % dims).alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["h"])


def coarse_number(value: Column) -> Column:
    """An order-keeping class of a non-negative number: 32 classes for each power of two, null -1."""
    return F.coalesce(F.floor(F.log2(F.greatest(value, F.lit(0)) + F.lit(1.0)) * 32).cast("int"), F.lit(-1))


def with_cells(rows: DataFrame, texts: list[str], numbers: list[str], bits: int = BITS) -> tuple[DataFrame, list[str]]:
    """Adds a cell column for each dimension; cells hold near-equal numbers of rows.

    A cell follows from the number of rows with lesser values: whole strings, and classes
    of numbers.  The distinct values are counted and summed up along a range partitioning,
    whatever their number; an outlier takes its own rows' place and no more.
    """
    total = max(rows.count(), 1)
    out, cells = rows, []
    for name in [*texts, *numbers]:
        kind = F.col(name) if name in texts else coarse_number(F.col(name))
        counts = settle(rows.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n")), "cells")
        summed = running_total(counts, [], ["kind"], "n", "before", "cells-order")
        at, cell = free_name(out.columns, f"{name}_kind"), free_name(out.columns, f"{name}_cell")
        share = (F.col("before") + F.col("n") / 2) / F.lit(total)
        mapping = settle(summed.select(F.col("kind").alias(at), F.floor(share * F.lit(1 << bits)).cast("int").alias(cell)), "cell-map")
        out = out.join(mapping, kind.eqNullSafe(mapping[at])).drop(at)
        cells.append(cell)
    return out, cells


def shard_rows(rows: DataFrame, texts: list[str], numbers: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to ``rows``, which must hold doc_id, size and a unique row_key."""
    celled, cells = with_cells(rows, texts, numbers, bits)
    curve, one, rank = (free_name(celled.columns, name) for name in ("curve", "one", "rank"))
    indexed = celled.withColumn(curve, hilbert_index([F.col(c) for c in cells], bits)).withColumn(one, F.lit(1).cast("long"))
    indexed = settle(indexed, "curve")
    ranked = running_total(indexed, [], [curve, "size", "doc_id", "row_key"], one, rank, "curve-order")
    n = rows.count()
    # Shard k holds the ranks from floor(k n / shards); whole-number arithmetic, so slots have no gap.
    shard = F.expr(f"(({rank} + 1) * {shards} - 1) div {max(n, 1)}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn(
        "slot", (F.col(rank) - F.expr(f"(shard * {max(n, 1)}) div {shards}")).cast("long")
    ).select(*rows.columns, "shard", "slot")


def described(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, lang, source, size, text_crc32) of every row, written once."""
    text = F.encode(F.col("text"), "utf-8")
    rows = docs.select(
        "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    return settle(rows.withColumn("row_key", F.monotonically_increasing_id()), "shard-rows")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as Parquet, one folder for each shard, in curve order within it."""
    key, shard, slot = (free_name(docs.columns, name) for name in ("row_key", "shard", "slot"))
    stored = settle(docs.withColumn(key, F.monotonically_increasing_id()), "shard-documents")
    rows = stored.select(F.col(key).alias("row_key"), "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    placed = shard_rows(rows, ["lang", "source"], ["size"], shards).select(F.col("row_key").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    (
        stored.join(placed, key).drop(key)
        .repartitionByRange(max(shards, partitions(docs)), shard, slot).sortWithinPartitions(shard, slot)
        .write.partitionBy(shard).parquet(path)
    )


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents over language, source and size."""
    rows = described(table(spark, sf_dir, "documents"))
    placed = shard_rows(rows, ["lang", "source"], ["size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "lang", "source"
    )
