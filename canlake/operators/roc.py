"""ROC curve and area from running counts over distinct scores.

Scores crowd near 0 and 1, so neither a fixed grid nor a window over all scores
would do.  Ties are merged first, then the distinct scores are range-ordered on
disk: a partition sums up locally and starts from the counts of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from canlake.operators.ordering import range_partitioned
from canlake.storage import scratch_path, settle

OVERALL = "OVERALL"


def running_counts(scored: DataFrame, overall: bool = True) -> DataFrame:
    """Per group and distinct score: positives and negatives at it and above it.

    ``scored`` has ``session_id``, ``attack`` (0/1) and ``score``; the union of all
    sessions is added as group ``OVERALL``.  Columns: ``session_id``, ``score``,
    ``pos``, ``neg``, ``pos_above``, ``neg_above``, ``all_pos``, ``all_neg``.
    """
    spark = scored.sparkSession
    per_score = scored.groupBy("session_id", "score").agg(
        F.sum(F.col("attack").cast("long")).alias("pos"), F.sum(1 - F.col("attack").cast("long")).alias("neg")
    )
    if overall:
        per_score = per_score.unionByName(
            per_score.groupBy("score")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .withColumn("session_id", F.lit(OVERALL))
        )
    path = scratch_path(spark, "scores")
    (
        range_partitioned(per_score.withColumn("down", -F.col("score")), "session_id", "down")
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "zstd")
        .parquet(path)
    )
    stored = spark.read.parquet(path)
    ahead = W.partitionBy("session_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy("session_id")
    starts = settle(
        stored.groupBy("session_id", "part")
        .agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        .select(
            "session_id", "part",
            F.coalesce(F.sum("p").over(ahead), F.lit(0)).alias("pos_start"),
            F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("neg_start"),
            F.sum("p").over(group).alias("all_pos"),
            F.sum("n").over(group).alias("all_neg"),
        ),
        "score-starts",
    )
    inside = W.partitionBy("session_id", "part").orderBy("down").rowsBetween(W.unboundedPreceding, -1)
    return (
        stored.withColumn("_p", F.coalesce(F.sum("pos").over(inside), F.lit(0)))
        .withColumn("_n", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
        .join(starts, ["session_id", "part"])
        .select(
            "session_id", "score", "pos", "neg",
            (F.col("_p") + F.col("pos_start")).alias("pos_above"),
            (F.col("_n") + F.col("neg_start")).alias("neg_above"),
            "all_pos", "all_neg",
        )
    )


def roc_auc(scored: DataFrame, overall: bool = True) -> DataFrame:
    """Area per session and overall; ties count half, one class only gives null."""
    counts = running_counts(scored, overall)
    below = F.col("all_neg") - F.col("neg_above") - F.col("neg")
    won = F.col("pos") * below + F.col("pos") * F.col("neg") / 2
    return (
        counts.groupBy("session_id")
        .agg(F.sum(won).alias("won"), F.first("all_pos").alias("p"), F.first("all_neg").alias("n"))
        .select(
            "session_id",
            F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("roc_auc"),
        )
    )


def roc_points(scored: DataFrame, overall: bool = True) -> DataFrame:
    """False and true positive rate at each distinct score taken as threshold."""
    counts = running_counts(scored, overall).where("all_pos > 0 AND all_neg > 0")
    return counts.select(
        "session_id",
        F.col("score").alias("threshold"),
        ((F.col("neg_above") + F.col("neg")) / F.col("all_neg")).alias("fpr"),
        ((F.col("pos_above") + F.col("pos")) / F.col("all_pos")).alias("tpr"),
    )
