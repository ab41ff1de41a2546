"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised in double precision.  In each of several tables a vector's key is
``k`` random projections, shifted and cut into steps of ``WIDTH``; vectors with one key meet in a
bucket.  ``k`` grows with the logarithm of the number of vectors, so that a bucket
holds less than one unrelated vector on average, and the number of tables is set so that a
pair just at the threshold meets in at least one with probability ``RECALL``.

A large group of near copies is not expanded into all pairs.  Every bucket has a hub, its
smallest vector; vectors within half the threshold angle of one hub are all linked with each
other by the triangle inequality, and form a cluster.  Between clusters that meet in a
bucket, the hubs' angle rules most pairs out; the members of the rest are compared one
by one.  All decisions use exact cosines.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and so do vectors of different length.  Rows are told apart by a key of their own,
so repeated vec_ids and equal vectors are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import kernels as K
from canlake.llm.common import components, table
from canlake.storage import settle

COSINE = 0.95
RECALL = 0.995
WIDTH = 1.6
SEED = 17


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two points of this distance into one step."""
    t = width / distance
    below = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_sizes(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections for each key and number of tables for ``n`` vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(2 * n, 4)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit): the direction as float64 bytes, null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                greatest = np.abs(x).max(initial=0)
                if not np.isfinite(greatest) or greatest == 0:
                    out.append(None)
                    continue
                x = x / greatest
                out.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, unit binary")


def buckets(units: DataFrame, k: int, tables: int, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """(bucket, row_key): ``tables`` rows for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("unit"))
            keys, lengths = batch.column("row_key").to_numpy(), np.diff(offsets) // 8
            for dim in np.unique(lengths).tolist():
                if dim not in planes:
                    rng = np.random.default_rng((seed, dim))
                    planes[dim] = rng.normal(size=(dim, k * tables)), rng.uniform(0, width, k * tables)
                projection, shift = planes[dim]
                rows = np.flatnonzero(lengths == dim)
                x = data[K.ragged(offsets[rows], lengths[rows] * 8)].view(np.float64).reshape(len(rows), dim)
                for a in range(0, len(rows), 512):
                    steps = np.floor((x[a : a + 512] @ projection + shift) / width).astype(np.int64).view(np.uint64)
                    steps = steps.reshape(-1, tables, k)
                    bucket = np.full(steps.shape[:2], dim, np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for i in range(k):
                        bucket = K.mixed(bucket ^ (steps[:, :, i] + np.uint64(i + 1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.reshape(-1).view(np.int64)), pa.array(np.repeat(keys[rows[a : a + 512]], tables))],
                        names=["bucket", "row_key"],
                    )

    return units.select("row_key", "unit").mapInArrow(run, "bucket long, row_key long")


def with_cosine(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Adds the exact cosine to (a, b); pairs of different length drop out."""
    left = units.select(F.col("row_key").alias("a"), F.col("unit").alias("left"))
    right = units.select(F.col("row_key").alias("b"), F.col("unit").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, x_at), (y, y_at) = K.text_buffers(batch.column("left")), K.text_buffers(batch.column("right"))
            sizes = np.diff(x_at) // 8
            same = np.flatnonzero(sizes == np.diff(y_at) // 8)
            dots = np.zeros(len(same))
            for dim in np.unique(sizes[same]).tolist():
                at = np.flatnonzero(sizes[same] == dim)
                n = np.full(len(at), dim * 8)
                u = x[K.ragged(x_at[same[at]], n)].view(np.float64).reshape(-1, dim)
                v = y[K.ragged(y_at[same[at]], n)].view(np.float64).reshape(-1, dim)
                dots[at] = np.einsum("ij,ij->i", u, v)
            rows = pa.array(same)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(dots)], names=["a", "b", "cosine"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, cosine double")


def clusters(met: DataFrame, units: DataFrame, cosine: float) -> DataFrame:
    """(row_key, hub, reach): members of clusters in which every two vectors are linked.

    ``reach`` is the cosine to the hub.  A hub belongs to its own cluster only.
    """
    tight = math.cos(math.acos(cosine) / 2) + 1e-12
    stars = with_cosine(met.where("row_key <> hub").select(F.col("hub").alias("a"), F.col("row_key").alias("b")).distinct(), units)
    near = settle(stars.where(F.col("cosine") >= tight), "near-hubs")
    taken = near.select(F.col("b").alias("a")).distinct()
    free = near.join(taken, "a", "left_anti")
    return settle(
        free.groupBy("b").agg(F.min(F.struct("a", "cosine")).alias("best")).select(F.col("b").alias("row_key"), "best.a", "best.cosine").toDF("row_key", "hub", "reach"),
        "near-clusters",
    )


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    stored = settle(unit_vectors(vectors).withColumn("row_key", F.monotonically_increasing_id()), "units")
    units = stored.where("unit is not null").select("row_key", "unit")
    dealt = settle(buckets(units, *table_sizes(units.count(), cosine, recall)), "buckets")
    shared = dealt.groupBy("bucket").agg(F.min("row_key").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = settle(dealt.join(shared, "bucket"), "met")

    member = clusters(met, units, cosine)
    of = member.select("row_key", F.col("hub").alias("cluster"))
    grouped = met.join(of, "row_key", "left").select("bucket", F.coalesce("cluster", "row_key").alias("cluster")).distinct()
    several = grouped.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    grouped = settle(grouped.join(several, "bucket"), "clusters-met")
    other = grouped.select("bucket", F.col("cluster").alias("b"))
    between = grouped.withColumnRenamed("cluster", "a").join(other, "bucket").where("a < b").select("a", "b").distinct()
    widest = member.groupBy("hub").agg(F.min("reach").alias("reach"))
    angle = with_cosine(between, units).withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine")))))
    for side in ("a", "b"):
        angle = angle.join(widest.select(F.col("hub").alias(side), F.acos(F.least("reach", F.lit(1.0))).alias(f"wide_{side}")), side, "left")
    possible = angle.where(
        F.col("angle") <= math.acos(cosine) + 1e-9 + F.coalesce("wide_a", F.lit(0.0)) + F.coalesce("wide_b", F.lit(0.0))
    ).select("a", "b")
    possible = settle(possible, "cluster-pairs")
    all_members = member.select("hub", "row_key").union(member.select("hub", F.col("hub").alias("row_key")).distinct())
    for side, name in (("a", "u"), ("b", "v")):
        possible = possible.join(all_members.select(F.col("hub").alias(side), F.col("row_key").alias(name)), side, "left").withColumn(name, F.coalesce(name, side))
    links = settle(with_cosine(possible.select(F.col("u").alias("a"), F.col("v").alias("b")), units).where(F.col("cosine") >= cosine).select("a", "b"), "links")

    size = member.groupBy("hub").agg(F.count("*").alias("inside"))
    inside = member.join(size, "hub").select("row_key", "inside").union(size.select(F.col("hub").alias("row_key"), "inside"))
    counts = inside.select("row_key", F.col("inside").alias("n")).union(
        links.select(F.col("a").alias("row_key"), F.lit(1).cast("long").alias("n"))
    ).union(links.select(F.col("b").alias("row_key"), F.lit(1).cast("long").alias("n"))).groupBy("row_key").agg(F.sum("n").alias("n_links"))
    edges = links.union(member.select(F.col("hub").alias("a"), F.col("row_key").alias("b")))
    labels = components(edges, "vector").withColumnRenamed("node", "row_key")
    ids = stored.select("row_key", "vec_id")
    named = settle(ids.join(labels, "row_key").join(counts, "row_key", "left"), "vector-labels")
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = named.join(smallest, "component").select("row_key", "n_links", "component_id")
    return ids.join(linked, "row_key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
