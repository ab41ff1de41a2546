"""Table contracts, label schemas and the checks made before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

BYTE_COLUMNS = [f"Data_{i}" for i in range(8)]

CANONICAL = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("Timestamp", T.DoubleType()),
        T.StructField("Arbitration_ID", T.StringType()),
        T.StructField("DLC", T.ShortType()),
        *[T.StructField(name, T.StringType()) for name in BYTE_COLUMNS],
        T.StructField("attack_type", T.StringType()),
    ]
)

WINDOW_INDEX = T.StructType(
    [
        T.StructField("window_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("start_row_id", T.LongType()),
        T.StructField("window_size", T.LongType()),
        T.StructField("label", T.LongType()),
    ]
)


@dataclass(frozen=True)
class LabelSchema:
    """Class names by id; ``attack_types`` are the source labels in id order."""

    name: str
    class_names: tuple[str, ...]
    attack_types: tuple[str, ...]
    benign: tuple[int, ...] = (0,)

    @property
    def num_classes(self) -> int:
        return len(self.class_names)


# Label schemas (class ids are list positions).
FIVE_CLASS = ("Normal", "Flooding", "Fuzzing", "Spoofing", "Replay")
TEN_STATE = (
    "benign-driving", "DoS-driving", "Fuzzing-driving", "Spoofing-driving", "Replay-driving",
    "benign-stationary", "DoS-stationary", "Fuzzing-stationary", "Spoofing-stationary",
    "Replay-stationary",
)
CICIOV2024 = ("BENIGN", "DoS", "GAS", "RPM", "SPEED", "STEERING_WHEEL")
SURVIVAL = ("Normal", "Flooding", "Fuzzing", "Malfunction")
HCRL = ("Normal", "DoS", "Fuzzy", "Gear", "RPM")
MIRGU_REAL = ("Normal", "DoS", "Fuzzing", "Spoofing", "Replay")
MIRGU_EXTENDED = MIRGU_REAL + ("Masquerade", "Suspension")
ROAD_FABRICATION = ("Normal", "MEC", "Fuzzing", "MS", "RLOn", "RLOff", "CS")
ROAD_MASQUERADE = ("Normal", "MEC", "MS", "RLOn", "RLOff", "CS")

LABEL_SCHEMAS: dict[tuple[str, str | None], LabelSchema] = {
    ("binary", None): LabelSchema("binary", ("Normal", "Attack"), ()),
    ("five_class", None): LabelSchema("five_class", FIVE_CLASS, FIVE_CLASS),
    ("ten_state_attack", None): LabelSchema("ten_state_attack", TEN_STATE, FIVE_CLASS, (0, 5)),
    ("CICIoV2024", None): LabelSchema("CICIoV2024", CICIOV2024, CICIOV2024),
    ("SurvivalAnalysis", None): LabelSchema("SurvivalAnalysis", SURVIVAL, SURVIVAL),
    ("HCRLCarHacking", None): LabelSchema("HCRLCarHacking", HCRL, HCRL),
    ("CANMIRGU", "real"): LabelSchema("CANMIRGU", MIRGU_REAL, MIRGU_REAL),
    ("CANMIRGU", "extended"): LabelSchema("CANMIRGU", MIRGU_EXTENDED, MIRGU_EXTENDED),
    ("road", "fabrication"): LabelSchema("road", ROAD_FABRICATION, ROAD_FABRICATION),
    ("road", "masquerade"): LabelSchema("road", ROAD_MASQUERADE, ROAD_MASQUERADE),
}

# What each detector consumes.
MODEL_UNITS = {
    "mlp": "frame",
    "mlp_window": "window",
    "can_bigrubert": "window",
    "can_ae_transformer": "window",
    "can_st_transformer": "window",
    "tct_ids": "window",
    "cnn_lstm": "window",
    "transformer_gru": "window",
    "hierarchical_transformer_gru": "window",
    "hat_ids": "window",
}


def label_schema(name: str, variant: str | None = None) -> LabelSchema:
    """Look a label schema up; only the two multi-corpus schemas take a variant."""
    variants = sorted(v for n, v in LABEL_SCHEMAS if n == name and v)
    found = LABEL_SCHEMAS.get((name, variant if variants else None))
    if found is not None:
        return found
    if variants:
        raise ValueError(f"label schema {name!r} needs a variant out of {variants}, got {variant!r}")
    raise ValueError(f"unknown label schema {name!r}; known: {sorted({n for n, _ in LABEL_SCHEMAS})}")


def require_columns(df: DataFrame, columns, what: str = "input") -> DataFrame:
    """Fail while planning when ``df`` lacks a column, naming all that are missing."""
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"{what} is missing required columns: {absent}")
    return df


def check_split_ratios(val_ratio: float, test_ratio: float) -> None:
    if not (0 <= val_ratio < 1 and 0 <= test_ratio < 1):
        raise ValueError("val_ratio and test_ratio must lie in [0, 1)")
    if val_ratio + test_ratio >= 1:
        raise ValueError("val_ratio + test_ratio must be less than 1")


def check_experiment(
    model: str, unit: str, schema: str, variant: str | None = None, num_classes: int | None = None
) -> LabelSchema:
    """Model, split unit and label schema must agree; returns the schema."""
    resolved = label_schema(schema, variant)
    if model not in MODEL_UNITS:
        raise ValueError(f"unknown model {model!r}; known: {sorted(MODEL_UNITS)}")
    if unit != MODEL_UNITS[model]:
        raise ValueError(f"model {model!r} needs unit {MODEL_UNITS[model]!r}, not {unit!r}")
    if num_classes is not None and num_classes != resolved.num_classes:
        raise ValueError(
            f"model {model!r} has {num_classes} classes, schema {schema!r} has {resolved.num_classes}"
        )
    return resolved
