"""Session-bounded sliding windows: candidates, references and materialisation.

Windows are found by arithmetic on positions.  For labels, frames are folded into
panes of ``gcd(size, stride)`` frames (map-side) and only panes are copied to the
windows that cover them.  For contents, frames are shuffled once by block.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canlake.functions import encodings as enc
from canlake.functions.hexfields import decoded
from canlake.functions.labels import is_benign
from canlake.operators.normalise import NormStats, scaled_frame_vector
from canlake.operators.ordering import BLOCK_ROWS, block_of, with_halo
from canlake.schemas import LabelSchema

CLASS_SPAN = 256  # class ids fit one byte
LABEL_RULES = ("last_frame", "any_attack")


def covering_windows(
    position: Column, size: int, stride: int, length: int = 1, among: tuple[Column, Column] | None = None
) -> Column:
    """Ordinals of the windows that contain positions ``[position, position+length)``.

    ``among`` narrows them to an inclusive range of ordinals.
    """
    lowest = F.greatest(F.ceil((position + (length - size)) / F.lit(stride)), F.lit(0))
    highest = F.floor(position / F.lit(stride))
    if among is not None:
        lowest, highest = F.greatest(lowest, among[0]), F.least(highest, among[1])
    return F.when(highest >= lowest, F.sequence(lowest, highest)).otherwise(F.array().cast("array<bigint>"))


def candidate_windows(frames: DataFrame, size: int, stride: int, schema: LabelSchema) -> DataFrame:
    """Full windows at every ``stride`` with the label of their first attack frame.

    A window without attack takes the label of its first frame.  The first attack is
    kept as ``position * CLASS_SPAN + class``: one number, so that both aggregations
    stay hash aggregations.
    """
    pane = gcd(size, stride)
    leads = F.col("pos") % pane == 0
    attack = F.when(~is_benign("Class", schema), F.col("pos") * CLASS_SPAN + F.col("Class"))
    panes = frames.groupBy("session_id", F.floor(F.col("pos") / pane).alias("pane")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(leads, F.col("row_id"))).alias("row_id"),
        F.max(F.when(leads, F.col("Class"))).alias("lead_class"),
        F.min(attack).alias("attack"),
    )
    opens = F.col("pane") == F.col("window") * (stride // pane)
    return (
        panes.withColumn("window", F.explode(covering_windows(F.col("pane") * pane, size, stride, pane)))
        .groupBy("session_id", "window")
        .agg(
            F.sum("n").alias("n"),
            F.max(F.when(opens, F.col("row_id"))).alias("start_row_id"),
            F.max(F.when(opens, F.col("lead_class"))).alias("lead_class"),
            F.min("attack").alias("attack"),
        )
        .where(F.col("n") == size)
        .select(
            "session_id",
            (F.col("window") * stride).alias("start_pos"),
            "start_row_id",
            F.coalesce(F.col("attack") % CLASS_SPAN, F.col("lead_class")).cast("long").alias("label"),
        )
    )


def last_frame_windows(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """Full windows at every ``stride`` with the label of their last frame.

    Only the first and last frame of each window is shuffled.
    """
    reach = size - 1
    first = (F.col("pos") % stride) == 0
    last = (F.col("pos") >= reach) & (((F.col("pos") - reach) % stride) == 0)
    ends = frames.where(first | last).select(
        "session_id", "row_id", "pos", "Class", first.alias("first"), last.alias("last")
    )
    edges = ends.select(
        "session_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("first"), F.struct(F.col("pos").alias("start_pos"), F.col("row_id").alias("row"), F.lit(None).cast("int").alias("cls"))),
                    F.when(F.col("last"), F.struct((F.col("pos") - reach).alias("start_pos"), F.lit(None).cast("long").alias("row"), F.col("Class").cast("int").alias("cls"))),
                )
            )
        ).alias("edge"),
    )
    return (
        edges.groupBy("session_id", F.col("edge.start_pos").alias("start_pos"))
        .agg(F.max("edge.row").alias("start_row_id"), F.max("edge.cls").cast("long").alias("label"))
        .where("start_row_id IS NOT NULL AND label IS NOT NULL")
    )


def window_references(windows: DataFrame, size: int, positions: bool = False) -> DataFrame:
    """The compact index: window id, session, first row, size, label.

    With ``positions`` the index also keeps ``start_pos``, which saves later operators
    the look-up of the first frame.
    """
    return windows.select(
        F.concat_ws(":", "session_id", "start_row_id").alias("window_id"),
        "session_id",
        "start_row_id",
        F.lit(size).cast("long").alias("window_size"),
        "label",
        *(["start_pos"] if positions else []),
    )


def with_start(index: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``start_pos`` unless the index has it; null where the first row is unknown."""
    if "start_pos" in index.columns:
        return index
    starts = frames.select("session_id", F.col("row_id").alias("start_row_id"), F.col("pos").alias("start_pos"))
    return index.join(starts, ["session_id", "start_row_id"], "left")


def unknown_sessions(index: DataFrame, frames: DataFrame) -> DataFrame:
    """Sessions an index refers to that have no frames."""
    return index.select("session_id").distinct().join(
        frames.select("session_id").distinct(), "session_id", "left_anti"
    )


def expand_references(index: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (window, frame), ``offset`` giving the frame's place in the window.

    The first frame is looked up by row id, the others by position: equi-joins on
    balanced keys, no range condition.
    """
    wanted = [c for c in columns if c not in ("session_id", "pos")]
    return (
        with_start(index, frames)
        .withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("window_size") - 1)))
        .withColumn("pos", F.col("start_pos") + F.col("offset"))
        .join(frames.select("session_id", "pos", *wanted), ["session_id", "pos"], "left")
    )


def materialise(index: DataFrame, frames: DataFrame, size: int, stride: int, arrays: dict[str, Column]) -> DataFrame:
    """The index with the contents of its full windows as arrays in frame order.

    Frames move once, by block (``gather_windows``); then windows meet the index on their
    first frame, one row for each window on either side.
    """
    gathered = gather_windows(frames, size, stride, arrays, {"start_row_id": (0, F.col("row_id"))})
    return index.join(gathered.drop("window"), ["session_id", "start_row_id"])


def incomplete_windows(index: DataFrame, frames: DataFrame) -> DataFrame:
    """Windows whose first row is absent or whose session ends too early.

    Positions have no gap, so the frames of a window follow from the session's last one.
    """
    lengths = frames.groupBy("session_id").agg((F.max("pos") + 1).alias("frames"))
    inside = F.greatest(F.least(F.col("frames") - F.col("start_pos"), F.col("window_size")), F.lit(0))
    return (
        with_start(index, frames)
        .join(lengths, "session_id", "left")
        .select("window_id", F.coalesce(F.when(F.col("start_pos").isNotNull(), inside), F.lit(0)).cast("long").alias("found"), "window_size")
        .where("found < window_size")
    )


def counts_beside(marks: DataFrame, askers: DataFrame, names: list[str], reach: tuple[int, int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds to each row of ``askers`` how many marks lie from ``pos + reach[0]`` to ``pos + reach[1]``, by name.

    Both have session_id and pos; ``marks`` has a flag column for each name.  Marks and askers
    move once, together, by block of positions (marks near an edge to two blocks); a count
    is the difference of two running counts along the block, so a wide reach costs no more than a narrow one.
    """
    low, high = reach
    placed = with_halo(marks.select("session_id", "pos", *names), before=max(-low, 0), after=max(high, 0), block_rows=block_rows).drop("core")
    asking = askers.withColumn("block", block_of("pos", block_rows)).withColumn("asks", F.lit(True))
    rows = asking.unionByName(placed, allowMissingColumns=True).repartition("session_id", "block")
    along = W.partitionBy("session_id", "block").orderBy("pos")
    upto, before = along.rangeBetween(W.unboundedPreceding, high), along.rangeBetween(W.unboundedPreceding, low - 1)
    counted = rows.withColumns(
        {n: F.coalesce(F.sum(n).over(upto), F.lit(0)) - F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names}
    )
    return counted.where("asks").drop("asks", "block")


def gather_windows(
    frames: DataFrame,
    size: int,
    stride: int,
    arrays: dict[str, Column],
    at: dict[str, tuple[int, Column]] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Contents of every full window: ``session_id``, ``window``, arrays and single values.

    ``arrays`` become arrays in frame order; ``at`` takes a value from the frame at one
    offset only.  Frames are shuffled once by (session, block), with the few rows a
    block's last windows reach into the next block.  Inside the block they are packed
    into panes of ``gcd(size, stride)`` frames, and panes, not frames, are copied to
    the windows; both groupings keep the block's partitioning, so nothing moves again.
    """
    singles = at or {}
    pane = gcd(size, stride)
    per_block = max(block_rows // stride, -(-size // stride))
    wanted = frames.select(
        "session_id", "pos", *[c.alias(n) for n, c in arrays.items()],
        *[F.when(F.col("pos") % pane == place % pane, value).alias(n) for n, (place, value) in singles.items()],
    )
    blocks = with_halo(wanted, after=size - 1, block_rows=per_block * stride).repartition("session_id", "block")
    panes = blocks.groupBy("session_id", "block", F.floor(F.col("pos") / pane).alias("pane")).agg(
        F.array_sort(F.collect_list(F.struct("pos", *arrays))).alias("items"),
        *[F.max(n).alias(n) for n in singles],
    )
    first = F.col("block") * per_block
    mine = covering_windows(F.col("pane") * pane, size, stride, pane, (first, first + (per_block - 1)))
    placed = panes.withColumn("window", F.explode(mine)).withColumn(
        "place", F.col("pane") - F.col("window") * (stride // pane)
    )
    return (
        placed.groupBy("session_id", "block", "window")
        .agg(
            F.sum(F.size("items")).alias("n"),
            F.array_sort(F.collect_list(F.struct("place", "items"))).alias("panes"),
            *[F.max(F.when(F.col("place") == k // pane, F.col(n))).alias(n) for n, (k, _) in singles.items()],
        )
        .where(F.col("n") == size)
        .withColumn("items", F.flatten("panes.items"))
        .select("session_id", "window", *[F.col(f"items.{n}").alias(n) for n in arrays], *singles)
    )


def collect_windows(expanded: DataFrame, keys: list[str], size: int, arrays: dict[str, Column]) -> DataFrame:
    """Arrays ordered by offset out of expanded references; a group has at most ``size`` rows."""
    packed = F.array_sort(F.collect_list(F.struct("offset", *[c.alias(n) for n, c in arrays.items()])))
    return (
        expanded.groupBy(*keys)
        .agg(packed.alias("_w"))
        .where(F.size("_w") == size)
        .select(*keys, *[F.col(f"_w.{name}").alias(name) for name in arrays])
    )


def relabel(index: DataFrame, frames: DataFrame, rule: str) -> DataFrame:
    """``any_attack`` keeps the index label, ``last_frame`` takes the last frame's class."""
    if rule not in LABEL_RULES:
        raise ValueError(f"unknown label rule {rule!r}; known: {list(LABEL_RULES)}")
    if rule == "any_attack":
        return index
    lasts = frames.select("session_id", F.col("pos").alias("last_pos"), F.col("Class").cast("long").alias("last_class"))
    return (
        with_start(index, frames)
        .withColumn("last_pos", F.col("start_pos") + F.col("window_size") - 1)
        .join(lasts, ["session_id", "last_pos"])
        .withColumn("label", F.col("last_class"))
        .select(*index.columns)
    )


def flattened_vectors(frames: DataFrame, size: int, stride: int, stats: NormStats | None = None) -> DataFrame:
    """One vector of ``size`` frame vectors per window, normalised when stats are given."""
    base = decoded(frames).withColumn("vector", enc.frame_vector() if stats is None else scaled_frame_vector(stats))
    return gather_windows(
        base, size, stride,
        {"vector": F.col("vector")},
        {"start_row_id": (0, F.col("row_id")), "label": (size - 1, F.col("Class").cast("long"))},
    ).select("session_id", "start_row_id", "label", F.flatten("vector").alias("vector"))


def masked_sequences(frames: DataFrame, size: int, stride: int, schema: LabelSchema) -> DataFrame:
    """Next-identifier samples: id tokens with the last one masked, its payload and target."""
    last = size - 1
    is_last = (F.col("pos") >= last) & ((F.col("pos") - last) % stride == 0)
    tokens = frames.withColumns({"token": enc.id_token(), "payload": F.when(is_last, enc.payload_tokens())})
    return gather_windows(
        tokens, size, stride,
        {"token": F.col("token")},
        {
            "start_row_id": (0, F.col("row_id")),
            "spatial": (last, F.col("payload")),
            "attack": (last, (~is_benign("Class", schema)).cast("int")),
        },
    ).select(
        "session_id", "start_row_id",
        F.concat(F.slice("token", 1, last), F.array(F.lit(enc.MASK_TOKEN))).alias("temporal"),
        "spatial",
        F.element_at("token", -1).alias("target"),
        "attack",
    )


def time_encoded_windows(frames: DataFrame, size: int, stride: int, width: int, alpha: float = 1e-7) -> DataFrame:
    """Per (window, frame): the window-relative time-smoothed positional encoding."""
    gathered = gather_windows(
        frames, size, stride, {"ts": F.col("Timestamp")}, {"start_row_id": (0, F.col("row_id"))}
    )
    placed = gathered.select(
        "session_id", "start_row_id", F.get("ts", F.lit(0)).alias("t0"), F.posexplode("ts").alias("offset", "ts")
    )
    position = enc.smoothed_position(F.col("offset"), F.col("ts") - F.col("t0"), alpha)
    return placed.withColumn("encoding", enc.sinusoids(position, width))
