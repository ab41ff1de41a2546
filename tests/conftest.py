import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from canlake.session import build_session

    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SMALL).exists():
        pytest.skip("driver tables are not here")
    return SMALL


FRAME_SCHEMA = (
    "row_id long, session_id string, Timestamp double, Arbitration_ID string, DLC int, "
    + ", ".join(f"Data_{i} string" for i in range(8))
    + ", Class int"
)


@pytest.fixture(scope="session")
def make_frames(spark):
    """Frames out of (row_id, session, time, id, class[, dlc, bytes]) tuples."""

    def make(rows):
        full = []
        for row in rows:
            row_id, session, time, can_id, label, *rest = row
            dlc = rest[0] if rest else 8
            data = list(rest[1]) if len(rest) > 1 else [f"{i + 1:02X}" for i in range(8)]
            full.append((row_id, session, float(time), can_id, dlc, *data, label))
        return spark.createDataFrame(full, FRAME_SCHEMA)

    return make
