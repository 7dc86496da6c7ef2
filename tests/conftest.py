from __future__ import annotations

import datetime as dt

import pytest

from tallyline.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("checkpoints"))
    session = build_session("tests", "local[8]", 8, {"spark.driver.memory": "6g", "spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def months(n: int, start: tuple[int, int] = (2022, 1)) -> list[dt.datetime]:
    first = start[0] * 12 + start[1] - 1
    return [dt.datetime((first + i) // 12, (first + i) % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="session")
def make_series(spark):
    """Long series table from {id: [values from 2022-01 on]}."""

    def make(data: dict[str, list], start: tuple[int, int] = (2022, 1)):
        rows = [(k, d, None if v is None else float(v))
                for k, values in data.items() for d, v in zip(months(len(values), start), values)]
        return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")

    return make


@pytest.fixture(scope="session")
def five_patterns(make_series):
    """Seasonal, growing, volatile, stable and declining series over 36 months, with fixed offsets."""
    import math

    wobble = [0.0, 2.0, -2.0, 1.0, -1.0]
    return make_series({
        "SKU001": [50 + 20 * math.sin(2 * math.pi * t / 12) + wobble[t % 5] for t in range(36)],
        "SKU002": [100 + 5 * t + wobble[t % 5] for t in range(36)],
        "SKU003": [250.0 if t % 2 else 150.0 for t in range(36)],
        "SKU004": [150 + wobble[t % 5] for t in range(36)],
        "SKU005": [300 - 5 * t + wobble[t % 5] for t in range(36)],
    })
