"""Attack families and class ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from canlake.schemas import LabelSchema, label_schema

STATIONARY = r"_S(?:_|$)"
DRIVING = r"_D(?:_|$)"


def class_id(schema: str, variant: str | None = None, strict: bool = True) -> Column:
    """Class id of ``attack_type``; an unknown label fails the job, or is null if not strict."""
    resolved = label_schema(schema, variant)
    attack = F.col("attack_type")
    if resolved.name == "binary":
        return (attack != "Normal").cast("int")
    pairs = []
    for index, name in enumerate(resolved.attack_types):
        pairs += [F.lit(name), F.lit(index)]
    found = F.try_element_at(F.create_map(*pairs), attack)
    if strict:
        problem = F.concat(F.lit("label outside the schema: "), F.coalesce(attack, F.lit("null")))
        found = F.coalesce(found, F.raise_error(problem).cast("int"))
    if resolved.name == "ten_state_attack":
        found = found + F.when(F.col("session_id").rlike(STATIONARY), 5).otherwise(0)
    return found.cast("int")


def is_benign(label: str | Column, schema: LabelSchema) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return label.isin(*schema.benign)


def unmapped_labels(df: DataFrame, schema: str, variant: str | None = None) -> DataFrame:
    """Labels that a schema does not know, with their row counts."""
    return (
        df.where(class_id(schema, variant, strict=False).isNull())
        .groupBy("attack_type")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def sessions_without_state(df: DataFrame) -> DataFrame:
    """Sessions named neither driving nor stationary; ten-state takes them as driving."""
    session = F.col("session_id")
    return df.select("session_id").where(~session.rlike(STATIONARY) & ~session.rlike(DRIVING)).distinct()


def first_marker(text: Column, markers, default: str | None = None, anchored: bool = False) -> Column:
    """Label of the first marker found in ``text`` (at its start when anchored)."""
    branches = None
    for marker, label in markers:
        hit = text.startswith(marker) if anchored else text.contains(marker)
        branches = F.when(hit, label) if branches is None else branches.when(hit, label)
    return branches.otherwise(F.lit(default))


# File-name markers of each corpus, in order of precedence.
ROAD_MARKERS = (
    ("correlated_signal", "CS"),
    ("fuzzing", "Fuzzing"),
    ("max_engine_coolant_temp", "MEC"),
    ("max_speedometer", "MS"),
    ("reverse_light_on", "RLOn"),
    ("reverse_light_off", "RLOff"),
)
SURVIVAL_MARKERS = (
    ("freedriving", "Normal"),
    ("flooding", "Flooding"),
    ("fuzzy", "Fuzzing"),
    ("malfunction", "Malfunction"),
)
HCRL_MARKERS = (("dos", "DoS"), ("fuzzy", "Fuzzy"), ("gear", "Gear"), ("rpm", "RPM"))
MIRGU_FOLDERS = (
    ("benign", "Normal"),
    ("masquerade_attacks", "Masquerade"),
    ("suspension_attacks", "Suspension"),
)
MIRGU_MARKERS = (("fuzzing", "Fuzzing"), ("dos", "DoS"), ("replay", "Replay"))


def road_family(stem: Column) -> Column:
    """ROAD family from the start of the capture name; null for ambient traffic."""
    return first_marker(F.lower(stem), ROAD_MARKERS, anchored=True)


def survival_family(stem: Column) -> Column:
    return first_marker(F.lower(stem), SURVIVAL_MARKERS)


def hcrl_family(stem: Column) -> Column:
    return first_marker(F.lower(stem), HCRL_MARKERS, default="Normal")


def mirgu_family(path: Column, stem: Column) -> Column:
    """CAN-MIRGU family: folder names first, then file-name markers; null if neither says."""
    folders = F.split(F.lower(path), "/")
    by_folder = None
    for folder, label in MIRGU_FOLDERS:
        hit = F.array_contains(folders, folder)
        by_folder = F.when(hit, label) if by_folder is None else by_folder.when(hit, label)
    by_name = first_marker(F.lower(stem), MIRGU_MARKERS)
    return F.coalesce(
        by_folder.otherwise(F.lit(None)),
        by_name,
        F.when(F.array_contains(folders, "real_attacks"), "Spoofing"),
    )


def compound_family(stem: Column, family: Column, can_id: Column, relative: Column) -> Column:
    """Three captures mix two families; the frame's id or time tells which one it is."""
    name = F.lower(stem)
    return (
        F.when(name == "fuzzing_valid_ids_dos", F.when(can_id == "000", "DoS").otherwise("Fuzzing"))
        .when(
            name == "reverse_speedometer_fuzzing_attack",
            F.when(relative < 70.0, "Spoofing").otherwise("Fuzzing"),
        )
        .when(name == "multiple_attacks_2", F.when(relative >= 880.0, "Fuzzing").otherwise("Spoofing"))
        .otherwise(family)
    )
