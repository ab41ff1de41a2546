"""Metrics against direct computation."""

import random

import pytest
from pyspark.sql import functions as F

from canlake.operators import roc, scoring

rng = random.Random(11)
PAIRS = [(rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 0, 1, 2, 4])) for _ in range(300)]


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame(PAIRS, "y_true int, y_pred int")


def per_class(pairs, c):
    tp = sum(t == c and p == c for t, p in pairs)
    fp = sum(t != c and p == c for t, p in pairs)
    fn = sum(t == c and p != c for t, p in pairs)
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0, tp + fn


def test_confusion_has_every_cell(predictions):
    cells = {(r["y_true"], r["y_pred"]): (r["n"], r["percentage"]) for r in scoring.confusion_counts(predictions, 5).collect()}
    assert len(cells) == 25
    for (t, p), (n, percentage) in cells.items():
        assert n == PAIRS.count((t, p))
        assert percentage == pytest.approx(n / max(sum(x == t for x, _ in PAIRS), 1) * 100)


def test_macro_is_over_present_classes(predictions):
    present = sorted({x for pair in PAIRS for x in pair})
    scores = [per_class(PAIRS, c) for c in present]
    row = scoring.macro_metrics(predictions).first()
    assert row["accuracy"] == pytest.approx(sum(t == p for t, p in PAIRS) / len(PAIRS))
    for i, name in enumerate(("precision_macro", "recall_macro", "f1_macro")):
        assert row[name] == pytest.approx(sum(s[i] for s in scores) / len(present))


def test_report_lists_absent_classes_with_zero(predictions):
    names = ["a", "b", "c", "never", "e"]
    report = {r["name"]: r for r in scoring.classification_report(predictions, names).collect()}
    assert tuple(report["never"])[1:4] == (0.0, 0.0, 0.0) and report["never"]["support"] == 0
    assert report["weighted avg"]["support"] == len(PAIRS)
    want = sum(per_class(PAIRS, c)[2] * per_class(PAIRS, c)[3] for c in (0, 1, 2, 4)) / len(PAIRS)
    assert report["weighted avg"]["f1"] == pytest.approx(want)


def test_smoothed_macro_counts_all_classes(predictions):
    scores = [per_class(PAIRS, c) for c in range(7)]
    row = scoring.smoothed_macro_metrics(predictions, 7).first()
    assert row["f1_macro"] == pytest.approx(sum(s[2] for s in scores) / 7, abs=1e-6)


def test_smoothed_macro_with_weights(spark):
    df = spark.createDataFrame([(0, 0, 0.5), (0, 1, 2.0)], "y_true int, y_pred int, w double")
    row = scoring.smoothed_macro_metrics(df, 2, F.col("w")).first()
    # class 0: tp .25, fp .25, fn .25 + 2; class 1: tp 0, fp 2
    assert row["precision_macro"] == pytest.approx(0.5 * 0.5, abs=1e-6)
    assert row["recall_macro"] == pytest.approx(0.25 / 2.5 / 2, abs=1e-6)


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "attack int, flagged int, session_id string")
    row = scoring.attack_metrics(empty).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"], row["total_frames"]) == (0, 0, 0, 0, 0)


def auc(rows):
    pos = [s for a, s in rows if a]
    neg = [s for a, s in rows if not a]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def test_auc_by_session_and_overall(spark):
    rows = [(f"s{rng.randrange(3)}", rng.randrange(2), round(rng.random(), 1)) for _ in range(200)]
    rows += [("ties", i % 2, 0.5) for i in range(10)] + [("one_class", 1, 0.1 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "session_id string, attack int, score double")
    got = {r["session_id"]: r["roc_auc"] for r in roc.roc_auc(df).collect()}
    for session in {r[0] for r in rows}:
        assert got[session] == (pytest.approx(auc([r[1:] for r in rows if r[0] == session])) if session != "one_class" else None)
    assert got["ties"] == 0.5
    assert got["OVERALL"] == pytest.approx(auc([r[1:] for r in rows]))


def test_roc_points_over_many_partitions(spark):
    rows = [("s", rng.randrange(2), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "session_id string, attack int, score double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["threshold"]: (r["fpr"], r["tpr"]) for r in roc.roc_points(df, overall=False).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    p, n = sum(a for _, a, _ in rows), sum(1 - a for _, a, _ in rows)
    for _, _, t in rows:
        want = (sum(not a and s >= t for _, a, s in rows) / n, sum(a and s >= t for _, a, s in rows) / p)
        assert got[t] == pytest.approx(want)


def test_rank_ties_take_the_lower_index(spark):
    df = spark.createDataFrame([([3.0, 5.0, 5.0, 1.0, 5.0], t) for t in range(5)], "x array<double>, t int")
    assert [r[0] for r in df.select(scoring.target_rank(F.col("x"), F.col("t"))).collect()] == [4, 1, 2, 5, 3]
    assert list(df.select(scoring.top_indices(F.col("x"), 4)).first()[0]) == [1, 2, 4, 0]
    assert df.select(scoring.arg_max(F.col("x"))).first()[0] == 1


def test_best_epoch_first_wins(spark):
    epochs = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, None)], "epoch long, f1 double")
    assert scoring.best_epoch(epochs, "f1").first()["epoch"] == 2
    assert scoring.best_epoch(epochs, "f1", "min").first()["epoch"] == 1
    with pytest.raises(ValueError, match="mode"):
        scoring.best_epoch(epochs, "f1", "best")


def test_cutoff_keeps_the_first_windows(spark):
    windows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "session_id string, start_pos long")
    cutoffs = spark.createDataFrame([("a", 7)], "session_id string, cutoff long")
    kept = scoring.before_cutoff(windows, cutoffs, size=4).groupBy("session_id").count().collect()
    assert {tuple(r) for r in kept} == {("a", 4), ("b", 3)}


def test_a_class_outside_the_schema_ends_the_job(spark):
    for pair in ((0, 3), (-1, 0), (None, 1)):
        rows = spark.createDataFrame([(0, 0), pair], "y_true int, y_pred int")
        with pytest.raises(Exception, match="is not a class below 3"):
            scoring.confusion_counts(rows, 3).collect()
