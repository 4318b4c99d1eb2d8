from __future__ import annotations

import datetime as dt
import os
import random
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def minute_bars(sessions: int = 3, per: int = 40, seed: int = 0, symbol: str = "T", start: float = 100.0) -> list[tuple]:
    """One-minute bars from 09:30 New York on winter weekdays, prices a random walk carried over sessions."""
    rng, out, price = random.Random(seed), [], start
    for s in range(sessions):
        first = dt.datetime(2024, 1, 8 + s, 14, 30)
        for i in range(per):
            close = price * (1 + rng.gauss(0, 0.002))
            high, low = max(price, close) * (1 + rng.random() * 1e-3), min(price, close) * (1 - rng.random() * 1e-3)
            out.append((symbol, first + dt.timedelta(minutes=i), price, high, low, close, float(rng.randint(1000, 5000))))
            price = close
    return out


BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
