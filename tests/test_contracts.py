"""Plan-time checks and the stages around them."""

import pytest

from canlake import schemas
from canlake.functions.labels import class_id, sessions_without_state, unmapped_labels
from canlake.operators.normalise import NormStats
from canlake.plans import stages


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match=r"\['Class', 'DLC'\]"):
        schemas.require_columns(spark.range(1), ["id", "DLC", "Class"])


@pytest.mark.parametrize("name,variant,classes", [
    ("binary", None, 2), ("five_class", None, 5), ("ten_state_attack", None, 10), ("CICIoV2024", None, 6), ("SurvivalAnalysis", None, 4),
    ("HCRLCarHacking", None, 5), ("CANMIRGU", "real", 5), ("CANMIRGU", "extended", 7), ("road", "fabrication", 7), ("road", "masquerade", 6),
])
def test_label_schemas(name, variant, classes):
    assert schemas.label_schema(name, variant).num_classes == classes


@pytest.mark.parametrize("name,variant,message", [("road", None, "variant"), ("CANMIRGU", "tiny", "variant"), ("six_class", None, "unknown")])
def test_bad_label_schemas(name, variant, message):
    with pytest.raises(ValueError, match=message):
        schemas.label_schema(name, variant)


def test_experiment_contract():
    assert schemas.check_experiment("mlp", "frame", "five_class", num_classes=5).name == "five_class"
    for args in (("mlp", "window", "five_class"), ("svm", "frame", "five_class"), ("hat_ids", "frame", "binary")):
        with pytest.raises(ValueError):
            schemas.check_experiment(*args)
    with pytest.raises(ValueError, match="classes"):
        schemas.check_experiment("mlp", "frame", "five_class", num_classes=4)


def test_unknown_label_fails_or_is_listed(spark):
    df = spark.createDataFrame([("Normal", "x_S"), ("Strange", "x_D_1"), (None, "y")], "attack_type string, session_id string")
    with pytest.raises(Exception, match="label outside the schema"):
        df.select(class_id("five_class")).collect()
    assert {r["attack_type"] for r in unmapped_labels(df, "five_class").collect()} == {"Strange", None}
    assert [r[0] for r in sessions_without_state(df).collect()] == ["y"]


@pytest.mark.parametrize("session,label,want", [("a_S", "Replay", 9), ("a_S_1", "Normal", 5), ("a_Sx", "Normal", 0), ("a_D", "Fuzzing", 2)])
def test_ten_state(spark, session, label, want):
    df = spark.createDataFrame([(label, session)], "attack_type string, session_id string")
    assert df.select(class_id("ten_state_attack")).first()[0] == want


def test_norm_stats_must_fit_the_vector():
    with pytest.raises(ValueError, match="statistics are for"):
        NormStats(("DLC",), (0.0,), (1.0,))


def test_prepare_and_split_stages(spark, make_frames, tmp_path):
    from pyspark.sql import functions as F

    source = make_frames([(i, f"c{i % 2}", i, "100", 0) for i in range(60)]).drop("Class").withColumn(
        "attack_type", F.when(F.col("row_id") > 40, "Replay").otherwise("Normal")
    )
    table, _ = stages.prepare(source, "five_class", features=["deltatime", "delta_id"])
    assert dict(table.dtypes)["Deltatime"] == dict(table.dtypes)["Delta_Id"] == "float"
    assert "attack_type" not in table.columns
    for i, (unit, strategy) in enumerate((u, s) for u in ("frame", "window") for s in ("session_holdout", "stratified_random")):
        stages.split(table, str(tmp_path / str(i)), "five_class", unit=unit, strategy=strategy, window_size=4, stride=2,
                     val_sessions=["c0"] if strategy == "session_holdout" else ())
        assert spark.read.parquet(str(tmp_path / str(i))).count() == (60 if unit == "frame" else 28)
    with pytest.raises(ValueError, match="unknown features"):
        stages.prepare(source, "five_class", features=["speed"])
    with pytest.raises(ValueError, match="Timestamp"):
        stages.prepare(source.drop("Timestamp"), "five_class", features=["deltatime"])
    with pytest.raises(ValueError, match="strategy"):
        stages.split(table, str(tmp_path / "x"), "five_class", strategy="random")
    with pytest.raises(ValueError, match="unit"):
        stages.split(table, str(tmp_path / "x"), "five_class", unit="byte")


def test_tables_without_time_are_ordered_by_row(spark, make_frames):
    from pyspark.sql import functions as F

    source = make_frames([(i, "s", 0, "100", 0) for i in range(9)]).drop("Class", "Timestamp").withColumn("attack_type", F.lit("BENIGN"))
    table, _ = stages.prepare(source, "CICIoV2024")
    assert [(r["row_id"], r["pos"]) for r in table.orderBy("row_id").collect()] == [(i, i) for i in range(9)]
