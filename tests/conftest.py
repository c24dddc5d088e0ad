from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from helioframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows with ISO text in the named time column -> DataFrame with TIMESTAMP_NTZ."""

    def build(rows, schema, ts="ts"):
        names = [part.split()[0] for part in schema.split(",")]
        at = names.index(ts) if ts in names else None
        fixed = [
            tuple(datetime.fromisoformat(v) if i == at and isinstance(v, str) else v for i, v in enumerate(r))
            for r in rows
        ]
        return spark.createDataFrame(fixed, schema)

    return build


def hours(start: str, n: int) -> list[datetime]:
    first = datetime.fromisoformat(start)
    return [first + timedelta(hours=i) for i in range(n)]


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
