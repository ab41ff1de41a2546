"""Detection metrics over simulated predictions and embedding logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from canlake.operators import roc, scoring, windows as win
from canlake.plans import standin as st
from canlake.plans.catalog.registry import query
from canlake.plans.catalog.twins import PREDICTIONS, windows

CLASSES = 5


def rounded(df, keep, measures, digits=9):
    return df.select(*keep, *[F.round(m, digits).alias(m) for m in measures])


CELLS = PREDICTIONS + f""",
grid AS (SELECT CAST(t.i AS INTEGER) AS y_true, CAST(p.i AS INTEGER) AS y_pred FROM range(0, {CLASSES}) AS t(i) CROSS JOIN range(0, {CLASSES}) AS p(i)),
cells AS (SELECT g.y_true, g.y_pred, count(x.row_id) AS n FROM grid g LEFT JOIN predictions x ON x.y_true = g.y_true AND x.y_pred = g.y_pred GROUP BY 1, 2)"""


@query("a15_confusion_counts", f"WITH {CELLS} SELECT * FROM cells")
def confusion_counts(spark, sf_dir):
    return scoring.confusion_counts(st.predictions(spark, sf_dir), CLASSES).select("y_true", "y_pred", "n")


@query(
    "a16_confusion_percentages",
    f"WITH {CELLS} SELECT y_true, y_pred, round(n / greatest(sum(n) OVER (PARTITION BY y_true), 1)::DOUBLE * 100, 9) AS percentage FROM cells",
)
def confusion_percentages(spark, sf_dir):
    return rounded(scoring.confusion_counts(st.predictions(spark, sf_dir), CLASSES), ["y_true", "y_pred"], ["percentage"])


def _scores(weight: str = "1.0::DOUBLE") -> str:
    return PREDICTIONS + f""",
sums AS (
  SELECT c, sum(CASE WHEN y_true = c AND y_pred = c THEN {weight} ELSE 0 END) AS tp, sum(CASE WHEN y_true <> c AND y_pred = c THEN {weight} ELSE 0 END) AS fp,
         sum(CASE WHEN y_true = c AND y_pred <> c THEN {weight} ELSE 0 END) AS fn
  FROM predictions, range(0, {CLASSES}) AS t(c) GROUP BY c
),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM sums),
scores AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr)"""


@query(
    "a17_macro_metrics",
    f"""WITH {_scores()} SELECT round(sum(tp) / sum(tp + fn), 9) AS accuracy, round(avg(p), 9) AS precision_macro, round(avg(r), 9) AS recall_macro,
        round(avg(f), 9) AS f1_macro FROM scores WHERE tp + fp + fn > 0""",
)
def macro_metrics(spark, sf_dir):
    return rounded(scoring.macro_metrics(st.predictions(spark, sf_dir)), [], ["accuracy", "precision_macro", "recall_macro", "f1_macro"])


@query(
    "a18_classification_report",
    f"""WITH {_scores()}, named AS (SELECT *, ['Normal','Flooding','Fuzzing','Spoofing','Replay'][c + 1] AS name FROM scores)
        SELECT name, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, CAST(tp + fn AS BIGINT) AS support FROM named
        UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), CAST(sum(tp + fn) AS BIGINT) FROM named
        UNION ALL SELECT 'weighted avg', round(sum(p * (tp + fn)) / sum(tp + fn), 9), round(sum(r * (tp + fn)) / sum(tp + fn), 9),
        round(sum(f * (tp + fn)) / sum(tp + fn), 9), CAST(sum(tp + fn) AS BIGINT) FROM named""",
)
def classification_report(spark, sf_dir):
    report = scoring.classification_report(st.predictions(spark, sf_dir), st.FIVE.class_names)
    return rounded(report, ["name", "support"], ["precision", "recall", "f1"])


EPS = "1e-9::DOUBLE"


@query(
    "a19_smoothed_macro_metrics",
    f"""WITH {PREDICTIONS}, weighted AS (SELECT *, (1 + row_id % 3) / 2.0::DOUBLE AS w FROM predictions),
        sums AS (SELECT c,
          sum(CASE WHEN y_true = c AND y_pred = c THEN w * w ELSE 0 END) AS tp,
          sum(CASE WHEN y_pred = c AND y_true <> c THEN w WHEN y_pred = c THEN w - w * w ELSE 0 END) AS fp,
          sum(CASE WHEN y_true = c AND y_pred <> c THEN w WHEN y_true = c THEN w - w * w ELSE 0 END) AS fn
          FROM weighted, range(0, 7) AS t(c) GROUP BY c),
        pr AS (SELECT tp / (tp + fp + {EPS}) AS p, tp / (tp + fn + {EPS}) AS r FROM sums)
        SELECT round(avg(p), 9) AS precision_macro, round(avg(r), 9) AS recall_macro, round(avg(2 * p * r / (p + r + {EPS})), 9) AS f1_macro FROM pr""",
)
def smoothed_macro_metrics(spark, sf_dir):
    weight = (1 + F.col("row_id") % 3) / F.lit(2.0)
    found = scoring.smoothed_macro_metrics(st.predictions(spark, sf_dir), 7, weight)
    return rounded(found, [], ["precision_macro", "recall_macro", "f1_macro"])


BINARY = """count(*) FILTER ({t} AND {g}) AS tp, count(*) FILTER (NOT {t} AND NOT {g}) AS tn,
         count(*) FILTER (NOT {t} AND {g}) AS fp, count(*) FILTER ({t} AND NOT {g}) AS fn"""
BINARY_SCORES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 9) AS precision,
         round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 9) AS recall,
         round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) ELSE 0 END, 9) AS f1,
         round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn)::DOUBLE ELSE 0 END, 9) AS accuracy"""
COUNTS = ["tp", "tn", "fp", "fn"]
MEASURES = ["precision", "recall", "f1", "accuracy"]
TOTALS = ["total_frames", "normal_frames", "attack_frames"]
TOTALS_SQL = "tp + tn + fp + fn AS total_frames, tn + fp AS normal_frames, tp + fn AS attack_frames"
DECIDED = BINARY.format(t="attack = 1", g="flagged = 1")


@query(
    "a20_attack_metrics",
    f"WITH {PREDICTIONS}, c AS (SELECT {DECIDED} FROM decisions) SELECT tp, tn, fp, fn, {TOTALS_SQL}, {BINARY_SCORES} FROM c",
)
def attack_metrics(spark, sf_dir):
    return rounded(scoring.attack_metrics(st.decisions(spark, sf_dir)), COUNTS + TOTALS, MEASURES)


@query(
    "a21_attack_metrics_by_session",
    f"""WITH {PREDICTIONS}, c AS (SELECT COALESCE(session_id, 'OVERALL') AS session_id, {DECIDED} FROM decisions GROUP BY ROLLUP (session_id))
        SELECT session_id, tp, tn, fp, fn, {TOTALS_SQL}, {BINARY_SCORES} FROM c""",
)
def attack_metrics_by_session(spark, sf_dir):
    found = scoring.attack_metrics_by_session(st.decisions(spark, sf_dir))
    return rounded(found, ["session_id"] + COUNTS + TOTALS, MEASURES)


SCORED = PREDICTIONS + """,
per_score AS (
  SELECT COALESCE(session_id, 'OVERALL') AS session_id, score, sum(attack)::BIGINT AS pos, sum(1 - attack)::BIGINT AS neg
  FROM decisions GROUP BY GROUPING SETS ((session_id, score), (score))
),
running AS (
  SELECT *, sum(pos) OVER w AS pos_up, sum(neg) OVER w AS neg_up,
         sum(pos) OVER (PARTITION BY session_id) AS all_pos, sum(neg) OVER (PARTITION BY session_id) AS all_neg
  FROM per_score WINDOW w AS (PARTITION BY session_id ORDER BY score DESC)
)"""


@query(
    "a22_roc_auc",
    f"""WITH {SCORED} SELECT session_id, round(CASE WHEN any_value(all_pos) > 0 AND any_value(all_neg) > 0
        THEN sum(pos * (all_neg - neg_up) + pos * neg / 2::DOUBLE) / (any_value(all_pos) * any_value(all_neg))::DOUBLE END, 9) AS roc_auc FROM running GROUP BY session_id""",
)
def roc_auc(spark, sf_dir):
    return rounded(roc.roc_auc(st.decisions(spark, sf_dir)), ["session_id"], ["roc_auc"])


@query(
    "a23_roc_points",
    f"""WITH {SCORED} SELECT session_id, score AS threshold, round(neg_up / all_neg::DOUBLE, 9) AS fpr, round(pos_up / all_pos::DOUBLE, 9) AS tpr
        FROM running WHERE all_pos > 0 AND all_neg > 0""",
)
def roc_points(spark, sf_dir):
    return rounded(roc.roc_points(st.decisions(spark, sf_dir)), ["session_id", "threshold"], ["fpr", "tpr"])


RANKED = """ranked AS (
  SELECT vec_id, label, embedding, 1 + len([x for x in embedding if x > embedding[label + 1]])
         + len([j for j in range(1, label + 1) if embedding[j] = embedding[label + 1]]) AS target_rank,
         'scn_' || (vec_id % 4) AS session_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS attack FROM embeddings
)"""


def ranked(spark, sf_dir):
    return st.logits(spark, sf_dir).select(
        "vec_id",
        scoring.target_rank(F.col("logits"), F.col("target")).alias("target_rank"),
        F.concat(F.lit("scn_"), (F.col("vec_id") % 4).cast("string")).alias("session_id"),
        (F.col("vec_id") % 3 == 0).cast("int").alias("attack"),
    )


@query("t03_target_rank", f"WITH {RANKED} SELECT vec_id, CAST(target_rank AS INTEGER) AS target_rank, target_rank <= 6 AS hit FROM ranked")
def target_rank(spark, sf_dir):
    return ranked(spark, sf_dir).select("vec_id", "target_rank", (F.col("target_rank") <= 6).alias("hit"))


@query(
    "t03_top_six",
    """WITH items AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
       best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM items)
       SELECT vec_id, string_agg(i::VARCHAR, ' ' ORDER BY r) AS top FROM best WHERE r <= 6 GROUP BY vec_id""",
)
def top_six(spark, sf_dir):
    top = scoring.top_indices(F.col("logits"), 6)
    return st.logits(spark, sf_dir).select("vec_id", F.array_join(F.transform(top, lambda i: i.cast("string")), " ").alias("top"))


@query(
    "t04_anomaly_score",
    """WITH items AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
       peaks AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS top FROM items)
       SELECT vec_id, round(1 - sum(CASE WHEN i = label THEN exp(x - top) ELSE 0 END) / sum(exp(x - top)), 9) AS score FROM peaks GROUP BY vec_id""",
)
def anomaly_score(spark, sf_dir):
    return st.logits(spark, sf_dir).select(
        "vec_id", F.round(scoring.anomaly_score(F.col("logits"), F.col("target")), 9).alias("score")
    )


@query(
    "t05_arg_max",
    "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted FROM embeddings",
)
def arg_max(spark, sf_dir):
    return st.logits(spark, sf_dir).select("vec_id", scoring.arg_max(F.col("logits")).alias("predicted"))


@query(
    "a24_range_study",
    f"""WITH {RANKED}, c AS (SELECT COALESCE(session_id, 'OVERALL') AS session_id, k, {BINARY.format(t="attack = 1", g="target_rank > k")}
          FROM ranked, range(1, 7) AS t(k) GROUP BY GROUPING SETS ((session_id, k), (k)))
        SELECT session_id, CAST(k AS INTEGER) AS top_k, CAST(k - 1 AS INTEGER) AS "range", tp, tn, fp, fn, {BINARY_SCORES} FROM c""",
)
def range_study(spark, sf_dir):
    found = scoring.range_study(ranked(spark, sf_dir))
    return rounded(found, ["session_id", "top_k", "range"] + COUNTS, MEASURES)


METRIC_NAMES = ["loss", "accuracy", "precision_macro", "recall_macro", "f1_macro"]
EPOCHS = """epochs AS (
  SELECT o_orderkey % 100 AS epoch, round(avg(o_totalprice) / 1000.0::DOUBLE, 6) AS loss, round(avg(o_totalprice / 600000.0::DOUBLE), 6) AS accuracy,
         round(min(o_totalprice) / 600000.0::DOUBLE, 6) AS precision_macro, round(max(o_totalprice) / 600000.0::DOUBLE, 6) AS recall_macro,
         round(avg((o_totalprice - 1000.0::DOUBLE) / 600000.0::DOUBLE), 6) AS f1_macro FROM orders GROUP BY 1
),
metrics AS (SELECT *, """ + ", ".join(f"round({m} * 0.9::DOUBLE, 6) AS val_{m}" for m in METRIC_NAMES) + """ FROM epochs),
best AS (SELECT * FROM metrics ORDER BY val_f1_macro DESC, epoch LIMIT 1)"""


@query("a25_best_epoch", f"WITH {EPOCHS} SELECT * FROM best")
def best_epoch(spark, sf_dir):
    return scoring.best_epoch(st.epoch_metrics(spark, sf_dir), "val_f1_macro")


@query(
    "a26_checkpoint_comparison",
    f"""WITH {EPOCHS} SELECT 'best_train' AS split, {', '.join(METRIC_NAMES)} FROM best
        UNION ALL SELECT 'best_validation', {', '.join('val_' + m for m in METRIC_NAMES)} FROM best
        UNION ALL SELECT 'test', {', '.join(METRIC_NAMES)} FROM epochs WHERE epoch = 7""",
)
def checkpoint_comparison(spark, sf_dir):
    epochs = st.epoch_metrics(spark, sf_dir)
    return scoring.metric_comparison(scoring.best_epoch(epochs, "val_f1_macro"), epochs.where("epoch = 7"))


@query(
    "w14_windows_before_cutoff",
    f"""WITH {windows()}, cuts AS (SELECT session_id, CAST(floor(max(n_frames) / 20) AS BIGINT) AS cutoff FROM prepared WHERE cap_no % 2 = 1 GROUP BY session_id),
        placed AS (SELECT c.*, row_number() OVER (PARTITION BY session_id ORDER BY start_pos) AS r FROM candidates c)
        SELECT p.session_id, p.start_row_id FROM placed p LEFT JOIN cuts USING (session_id) WHERE cutoff IS NULL OR r <= greatest(cutoff - 16 + 1, 0)""",
)
def windows_before_cutoff(spark, sf_dir):
    layout = st.layout(spark, sf_dir)
    cutoffs = layout.sessions.where(st.session_number(F.col("session_id")) % 2 == 1).select(
        "session_id", F.floor(F.col("n_frames") / 20).alias("cutoff")
    )
    index = win.candidate_windows(layout.frames, st.WINDOW, st.STRIDE, st.FIVE)
    return scoring.before_cutoff(index, cutoffs, st.WINDOW, st.STRIDE).select("session_id", "start_row_id")
