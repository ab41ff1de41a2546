"""SQL building blocks of the twins: the stand-in views as common table expressions."""

from __future__ import annotations

from canlake.operators.sampling import FACTOR, MODULUS, ROUNDS

BYTES = [f"Data_{i}" for i in range(8)]


def _byte(i: int, value: str) -> str:
    return f"CASE WHEN {i} < dlc THEN printf('%02X', CAST({value} AS BIGINT)) ELSE 'PAD' END AS Data_{i}"


FRAMES = f"""
events_k AS (
  SELECT event_id, user_id, ts, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         CAST(floor(event_id / 16) AS BIGINT) AS e16 FROM events
),
events_d AS (SELECT *, CAST(CASE WHEN k % 5 = 0 THEN k % 8 ELSE 8 END AS INTEGER) AS dlc FROM events_k),
frames AS (
  SELECT event_id AS row_id,
         'cap_' || (user_id % 15) || CASE WHEN user_id % 2 = 0 THEN '_D' ELSE '_S' END AS session_id,
         epoch_us(ts) / 1000000.0 AS "Timestamp",
         printf('%03X', (k * 37) % 2048) AS Arbitration_ID,
         dlc AS DLC,
         {_byte(0, '5')}, {_byte(1, 'e16 % 256')}, {_byte(2, 'user_id % 4 + CASE WHEN day(ts) % 15 IN (3, 6, 9, 12) THEN day(ts) % 15 // 3 ELSE 0 END * 40')},
         {', '.join(_byte(i, f'(event_id * {2 * i + 1} + k * 17) % 256') for i in range(3, 8))},
         CASE day(ts) % 15 WHEN 3 THEN 'Flooding' WHEN 6 THEN 'Fuzzing' WHEN 9 THEN 'Spoofing'
              WHEN 12 THEN 'Replay' ELSE 'Normal' END AS attack_type,
         CAST(user_id % 15 AS INTEGER) AS cap_no
  FROM events_d
)"""

LABELLED = FRAMES + """,
labelled AS (
  SELECT *, CAST(CASE attack_type WHEN 'Normal' THEN 0 WHEN 'Flooding' THEN 1 WHEN 'Fuzzing' THEN 2
                 WHEN 'Spoofing' THEN 3 WHEN 'Replay' THEN 4 END AS INTEGER) AS "Class"
  FROM frames
)"""

PREPARED = LABELLED + """,
prepared AS (
  SELECT *, row_number() OVER s - 1 AS pos,
         count(*) OVER (PARTITION BY session_id) AS n_frames,
         min("Timestamp") OVER (PARTITION BY session_id) AS t_first,
         max("Timestamp") OVER (PARTITION BY session_id) AS t_last,
         COALESCE("Timestamp" - lag("Timestamp") OVER s, 0.0) AS Deltatime,
         COALESCE("Timestamp" - lag("Timestamp") OVER i, 0.0) AS Delta_Id
  FROM labelled
  WINDOW s AS (PARTITION BY session_id ORDER BY "Timestamp", row_id),
         i AS (PARTITION BY session_id, Arbitration_ID ORDER BY "Timestamp", row_id)
)"""


def windows(size: int = 16, stride: int = 8) -> str:
    """CTE ``candidates``: first-attack labels; CTE ``lasts``: last-frame labels."""
    return PREPARED + f""",
candidates AS (
  SELECT session_id, row_id AS start_row_id, pos AS start_pos, CAST(COALESCE(attack, "Class") AS BIGINT) AS label
  FROM (SELECT *, first_value(CASE WHEN "Class" <> 0 THEN "Class" END IGNORE NULLS)
               OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS attack
        FROM prepared)
  WHERE pos % {stride} = 0 AND pos + {size} <= n_frames
),
lasts AS (
  SELECT session_id, row_id AS start_row_id, pos AS start_pos, CAST(last_class AS BIGINT) AS label
  FROM (SELECT *, lead("Class", {size - 1}) OVER (PARTITION BY session_id ORDER BY pos) AS last_class FROM prepared)
  WHERE pos % {stride} = 0 AND pos + {size} <= n_frames
)"""


def members(size: int = 16, stride: int = 8) -> str:
    """CTE ``members``: every frame of every candidate window with its offset."""
    return windows(size, stride) + f""",
members AS (
  SELECT c.session_id, c.start_row_id, c.start_pos, c.label, p.pos - c.start_pos AS offs, p.* EXCLUDE (session_id)
  FROM candidates c JOIN prepared p ON p.session_id = c.session_id AND p.pos BETWEEN c.start_pos AND c.start_pos + {size - 1}
)"""


def permutation(source: str, label: str, stream: int, name: str, size_of: str = "count(*)", seed: int = 42) -> str:
    """CTE ``name``: the size of each label of ``source`` and the numbers of its permutation, as lists by round."""
    draws = lambda j: "[" + ", ".join(f"(start * {pow(FACTOR, 4 * i + j + 8, MODULUS)} % {MODULUS})" for i in range(ROUNDS)) + "]"
    return f"""
{name}_n AS (SELECT {label} AS lab, CAST({size_of} AS BIGINT) AS size,
             CAST(({seed * 7919 + stream * 1299709} + {label} * 104729) % {MODULUS - 1} + 1 AS BIGINT) AS start FROM {source} GROUP BY {label}),
{name}_d AS (SELECT lab, size, CASE WHEN size < 2 THEN 0 ELSE CAST(1 AS BIGINT) << CAST(floor(log2(size)) AS INTEGER) END AS fold,
             unnest([1, 2, 3]) AS round, unnest({draws(0)}) AS dm, unnest({draws(1)}) AS ds, unnest({draws(2)}) AS dodd, unnest({draws(3)}) AS dt FROM {name}_n),
{name}_m AS (SELECT lab, size, fold, round, min(m) AS m, any_value(ds * size // {MODULUS}) AS s, any_value(2 * (dodd * fold // {MODULUS} // 2) + 1) AS o,
             any_value(dt * fold // {MODULUS}) AS t
             FROM (SELECT *, size * (200000 + dm % 600000) // 1000000 + i AS m FROM {name}_d, unnest(range(0, 500)) AS r(i))
             WHERE gcd(m, size) = 1 OR size < 2 GROUP BY ALL),
{name} AS (SELECT lab, size, any_value(fold) AS fold, list(m ORDER BY round) AS ms, list(s ORDER BY round) AS ss, list(o ORDER BY round) AS os, list(t ORDER BY round) AS ts
           FROM {name}_m GROUP BY lab, size)"""


def permuted(ordinal: str, of: str = "") -> str:
    """Rank of an ordinal by the lists of a ``permutation`` (qualified by ``of``, with its dot)."""
    first = f"((x * {of}ms[i] + {of}ss[i]) % {of}size)"
    return (
        f"CASE WHEN {of}size < 2 THEN CAST({ordinal} AS BIGINT) ELSE list_reduce([CAST(1 AS BIGINT), 2, 3], lambda x, i: CASE WHEN {first} < {of}fold "
        f"THEN ({first} * {of}os[i] + {of}ts[i]) % {of}fold ELSE {first} END, CAST({ordinal} AS BIGINT)) END"
    )


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def split_case(rank: str, size: str, val: float = 0.2, test: float = 0.2) -> str:
    n_val, n_test = f"CAST(floor({size} * {val}::DOUBLE) AS BIGINT)", f"CAST(floor({size} * {test}::DOUBLE) AS BIGINT)"
    return (
        f"CASE WHEN {rank} < {size} - {n_val} - {n_test} THEN 'train' "
        f"WHEN {rank} < {size} - {n_test} THEN 'val' ELSE 'test' END"
    )


def number(text: str) -> str:
    """Hex text as an integer; ``PAD`` and null give null."""
    return f"CASE WHEN {text} <> 'PAD' THEN CAST('0x' || {text} AS INTEGER) END"


def zero(text: str) -> str:
    return f"COALESCE({number(text)}, 0)"


PREDICTIONS = LABELLED + """,
predictions AS (
  SELECT row_id, session_id, "Class" AS y_true,
         CASE WHEN row_id % 10 = 0 THEN ("Class" + 1) % 5 ELSE "Class" END AS y_pred,
         ((row_id * 7919) % 1000) / 2000.0::DOUBLE + CASE WHEN "Class" > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM labelled
),
decisions AS (
  SELECT row_id, session_id, CASE WHEN y_true > 0 THEN 1 ELSE 0 END AS attack,
         CASE WHEN score > 0.5::DOUBLE THEN 1 ELSE 0 END AS flagged, score FROM predictions
)"""
