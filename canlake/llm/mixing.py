"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

A source's target is shared out by weight and stops at ``most`` times its size; the
excess is reshared by weight among the rest (water filling, solved with one window over
the sources: a source is full when the level at which it fills is below the final one).

A document's expected copies are target / size of its source.  Within a source the
documents are ordered by (size, row key), expected copies are prefix-summed in units of
2^-32 copies, one random offset for each source (from ``seed`` and the source) is added,
and a document is emitted once for every integer boundary its interval crosses.  As the
order is by size, every stretch of sizes gets its share of copies, so the words taken come near the
target.  Runs with one seed agree as long as doc_id orders equal sizes.

Sizes are word counts; null and empty texts have size 0 and take nothing.  A null source
is a source of its own (last).  Rows with the same doc_id are mixed separately.  An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canlake.llm.common import WORD, free_name, running_total, same, table
from canlake.storage import settle

SHARE = 1.5
MOST = 2.0
CYCLE = (5.0, 2.0, 1.0)
SEED = 42
UNIT = 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Adds ``weight``: the cycle's values along the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(place, F.lit(len(cycle))) + 1).cast("int")))


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight)."""
    cap = F.col("source_size") * F.lit(most)
    by_level = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    all_by_level = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sources.withColumn("cap", cap)
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("left_budget", F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("level", F.col("left_budget") / F.col("left_weight"))
        # The first source, in the order of filling, that does not fill up fixes the level of all after it.
        .withColumn("open_level", F.first(F.when(F.col("level") <= F.col("fills_at"), F.col("level")), ignorenulls=True).over(all_by_level))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("open_level"), F.col("fills_at")) * F.col("weight"))
    return filled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def measured(docs: DataFrame, label: str) -> DataFrame:
    """(row_key, doc_id, source, size) of every row, written once."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return settle(rows.withColumn("row_key", F.monotonically_increasing_id()), label)


def mix(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and ``copies`` to ``rows`` (row_key, doc_id, source, size)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = sources.withColumn("expected", F.round(rate * F.lit(UNIT)).cast("decimal(20,0)")).withColumn(
        "offset", F.pmod(F.xxhash64(F.coalesce("source", F.lit("\x00null")), F.lit(seed)), F.lit(UNIT)).cast("decimal(20,0)")
    )
    placed = running_total(rows.withColumn("one", F.lit(1).cast("long")), ["source"], ["size", "doc_id", "row_key"], "one", "place", "mix")
    # Expected copies are the same for all documents of a source, so their prefix sum is a product; decimals keep it exact.
    start = F.col("offset") + F.col("place").cast("decimal(18,0)") * F.col("expected")
    crossed = F.floor((start + F.col("expected")) / F.lit(UNIT).cast("decimal(20,0)")) - F.floor(start / F.lit(UNIT).cast("decimal(20,0)"))
    joined = placed.join(rates, same(placed, rates, ["source"]))
    kept = [placed[c] for c in rows.columns]
    return joined.select(*kept, "source_size", "target", crossed.cast("long").alias("copies"))


def mixed_rows(rows: DataFrame, share: float = SHARE, most: float = MOST, cycle: tuple[float, ...] = CYCLE, seed: int = SEED) -> DataFrame:
    sizes = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    return mix(rows, settle(targets(cyclic_weights(sizes, cycle), share, most), "mix-targets"), seed)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    size, key, copy = (free_name(docs.columns, name) for name in ("size", "row_key", "copy"))
    stored = docs.withColumn(size, word_count(F.col("text"))).withColumn(key, F.monotonically_increasing_id())
    stored = settle(stored, "mix-documents")
    rows = stored.select(F.col(key).alias("row_key"), "doc_id", "source", F.col(size).alias("size"))
    chosen = mixed_rows(rows, **options).where("copies > 0").select(F.col("row_key").alias(key), F.expr("explode(sequence(1, cast(copies as int)))").alias(copy))
    return stored.join(chosen, key).select(*docs.columns)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    mixed = mixed_rows(measured(table(spark, sf_dir, "documents"), "mix-rows"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
