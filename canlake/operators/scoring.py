"""Detection metrics out of one confusion count, plus top-k decisions on logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

EPSILON = 1e-9
METRICS = ("loss", "accuracy", "precision_macro", "recall_macro", "f1_macro")


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 on an empty denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def in_classes(column: str, num_classes: int) -> Column:
    """The class number; one outside 0..C-1, or none at all, ends the job instead of leaving the figures."""
    value = F.col(column)
    message = F.concat(F.lit(f"{column} is not a class below {num_classes}: "), F.coalesce(value.cast("string"), F.lit("null")))
    return F.when(value.between(0, num_classes - 1), value.cast("int")).otherwise(F.raise_error(message).cast("int"))


def confusion_counts(predictions: DataFrame, num_classes: int) -> DataFrame:
    """Every (y_true, y_pred) cell with its count and row percentage, zero cells included.

    The data is reduced to at most C x C counts first; the grid of cells is literal.
    """
    spark = predictions.sparkSession
    counts = (
        predictions.groupBy(in_classes("y_true", num_classes).alias("y_true"), in_classes("y_pred", num_classes).alias("y_pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = spark.range(num_classes * num_classes).select(
        F.floor(F.col("id") / num_classes).cast("int").alias("y_true"),
        (F.col("id") % num_classes).cast("int").alias("y_pred"),
    )
    row_total = F.sum("n").over(W.partitionBy("y_true"))
    return (
        grid.join(counts, ["y_true", "y_pred"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("percentage", F.col("n") / F.greatest(row_total, F.lit(1)) * 100)
    )


def per_class_counts(predictions: DataFrame, weight: Column | None = None, num_classes: int | None = None) -> DataFrame:
    """tp, fp, fn and support per class.

    Each prediction adds to its true and to its predicted class; the sums combine
    map-side and can be added up over batches.
    """
    w = F.lit(1.0) if weight is None else weight
    hit = F.col("y_true") == F.col("y_pred")
    roles = F.when(hit, F.array(role("y_true", tp=w))).otherwise(
        F.array(role("y_true", fn=w), role("y_pred", fp=w))
    )
    sums = (
        predictions.select(F.inline(roles))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    if num_classes is not None:
        every = predictions.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("class"))
        sums = every.join(sums, "class", "left").na.fill(0.0, ["tp", "fp", "fn"])
    return sums.withColumn("support", F.col("tp") + F.col("fn"))


def role(column: str, tp: Column | None = None, fp: Column | None = None, fn: Column | None = None) -> Column:
    zero = F.lit(0.0)
    return F.struct(
        F.col(column).cast("int").alias("class"),
        (zero if tp is None else tp).cast("double").alias("tp"),
        (zero if fp is None else fp).cast("double").alias("fp"),
        (zero if fn is None else fn).cast("double").alias("fn"),
    )


def with_class_scores(counts: DataFrame) -> DataFrame:
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", f_score(F.col("precision"), F.col("recall"))
    )


def macro_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy and macro precision, recall, F1 over the classes that occur."""
    scores = with_class_scores(per_class_counts(predictions))
    return scores.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def classification_report(predictions: DataFrame, class_names) -> DataFrame:
    """Per-class scores with support, then the macro and the support-weighted average.

    Classes that never occur are listed with zeros and left out of the averages.
    """
    scores = with_class_scores(per_class_counts(predictions, num_classes=len(class_names)))
    names = F.array(*[F.lit(n) for n in class_names])
    lines = scores.select(
        F.element_at(names, F.col("class") + 1).alias("name"), "precision", "recall", "f1",
        F.col("support").cast("long").alias("support"),
    )
    present = scores.where("tp + fp + fn > 0")
    measures = ("precision", "recall", "f1")
    macro = present.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").cast("long").alias("support"))
    weighted = present.agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
        F.sum("support").cast("long").alias("support"),
    )
    return (
        lines.unionByName(macro.withColumn("name", F.lit("macro avg")))
        .unionByName(weighted.withColumn("name", F.lit("weighted avg")))
    )


def smoothed_macro_metrics(predictions: DataFrame, num_classes: int, weight: Column | None = None) -> DataFrame:
    """Macro scores of the training loop: epsilon in every quotient, mean over all classes.

    A weight w scales both one-hot vectors, so an agreement adds w*w to tp and w - w*w
    to fp and fn, a disagreement adds w to fn of the true and to fp of the other class.
    """
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    hit = F.col("y_true") == F.col("y_pred")
    both, apart = w * w, w - w * w
    roles = F.when(hit, F.array(role("y_true", tp=both, fp=apart, fn=apart))).otherwise(
        F.array(role("y_true", fn=w), role("y_pred", fp=w))
    )
    sums = (
        predictions.withColumns({c: in_classes(c, num_classes) for c in ("y_true", "y_pred")})
        .select(F.inline(roles))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    every = predictions.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("class"))
    filled = every.join(sums, "class", "left").na.fill(0.0, ["tp", "fp", "fn"])
    p = F.col("tp") / (F.col("tp") + F.col("fp") + EPSILON)
    r = F.col("tp") / (F.col("tp") + F.col("fn") + EPSILON)
    return filled.agg(
        F.avg(p).alias("precision_macro"),
        F.avg(r).alias("recall_macro"),
        F.avg(2 * p * r / (p + r + EPSILON)).alias("f1_macro"),
    )


def attack_aggregates() -> list[Column]:
    truth, guess = F.col("attack") == 1, F.col("flagged") == 1
    return [
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
    ]


def with_attack_scores(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", f_score(F.col("precision"), F.col("recall")))
        .withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
        .withColumn("total_frames", tp + tn + fp + fn)
        .withColumn("normal_frames", tn + fp)
        .withColumn("attack_frames", tp + fn)
    )


def attack_metrics(decisions: DataFrame) -> DataFrame:
    """Binary metrics over columns ``attack`` and ``flagged``; attack is positive."""
    return with_attack_scores(decisions.agg(*attack_aggregates()))


def attack_metrics_by_session(decisions: DataFrame) -> DataFrame:
    """The same per session and over everything (session ``OVERALL``)."""
    return with_attack_scores(overall_named(decisions.rollup("session_id").agg(*attack_aggregates(), F.grouping("session_id").alias("_g"))))


def overall_named(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("session_id", F.when(F.col("_g") == 1, "OVERALL").otherwise(F.col("session_id"))).drop("_g")


def range_study(ranked: DataFrame, widest: int = 6) -> DataFrame:
    """Binary metrics when the target may be among the top 1 .. ``widest`` guesses.

    All ranges come out of one pass with conditional counts instead of ``widest``
    copies of every row.
    """
    truth = F.col("attack") == 1
    counts = []
    for k in range(1, widest + 1):
        flagged = F.col("target_rank") > k
        counts += [
            F.count_if(truth & flagged).alias(f"tp{k}"),
            F.count_if(~truth & ~flagged).alias(f"tn{k}"),
            F.count_if(~truth & flagged).alias(f"fp{k}"),
            F.count_if(truth & ~flagged).alias(f"fn{k}"),
        ]
    rolled = overall_named(ranked.rollup("session_id").agg(*counts, F.grouping("session_id").alias("_g")))
    per_range = F.array(
        *[
            F.struct(F.lit(k).alias("top_k"), *[F.col(f"{c}{k}").alias(c) for c in ("tp", "tn", "fp", "fn")])
            for k in range(1, widest + 1)
        ]
    )
    return with_attack_scores(rolled.select("session_id", F.inline(per_range))).withColumn(
        "range", F.col("top_k") - 1
    )


def target_rank(logits: Column, target: Column) -> Column:
    """1-based rank of the target logit; among equals the lower index ranks first."""
    own = F.get(logits, target)
    above = F.size(F.filter(logits, lambda x: x > own))
    equal_before = F.size(F.filter(logits, lambda x, i: (x == own) & (i < target)))
    return above + equal_before + 1


def top_indices(logits: Column, k: int) -> Column:
    """Indices of the ``k`` largest logits, best first, ties by lower index."""
    keyed = F.transform(logits, lambda x, i: F.struct((-x).alias("key"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["index"])


def anomaly_score(logits: Column, target: Column) -> Column:
    """One minus the softmax probability of the target."""
    wide = F.transform(logits, lambda x: x.cast("double"))
    peak = F.array_max(wide)
    total = F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))
    return F.lit(1.0) - F.exp(F.get(wide, target) - peak) / total


def arg_max(values: Column) -> Column:
    """Index of the largest value, the first among equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def best_epoch(epochs: DataFrame, monitor: str, mode: str = "max") -> DataFrame:
    """The metric row of the best epoch; the earliest among equals."""
    if mode not in ("max", "min"):
        raise ValueError(f"mode must be 'max' or 'min', not {mode!r}")
    sign = 1.0 if mode == "max" else -1.0
    key = F.struct((F.col(monitor) * sign).alias("value"), (-F.col("epoch")).alias("early"))
    return epochs.where(F.col(monitor).isNotNull()).agg(
        F.max_by(F.struct(*epochs.columns), key).alias("best")
    ).select("best.*")


def metric_comparison(best: DataFrame, test: DataFrame, metrics=METRICS) -> DataFrame:
    """Rows best_train, best_validation, test with one column per metric."""
    train = best.select(F.lit("best_train").alias("split"), *[F.col(m) for m in metrics])
    validation = best.select(F.lit("best_validation").alias("split"), *[F.col(f"val_{m}").alias(m) for m in metrics])
    tested = test.select(F.lit("test").alias("split"), *[F.col(m) for m in metrics])
    return train.unionByName(validation).unionByName(tested)


def before_cutoff(windows: DataFrame, cutoffs: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """The first ``cutoff - size + 1`` windows of each session that has a cutoff.

    The place of a window in its session follows from its position, so no ranking.
    """
    allowed = F.greatest(F.col("cutoff") - size + 1, F.lit(0))
    return (
        windows.join(cutoffs, "session_id", "left")
        .where(F.col("cutoff").isNull() | (F.floor(F.col("start_pos") / stride) < allowed))
        .drop("cutoff")
    )
