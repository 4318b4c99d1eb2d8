from __future__ import annotations

import pytest
from conftest import BARS
from pyspark.sql import functions as F
from test_stream_state import CONFIG, in_parts, two_symbols

from tapeforms.operators import bars as B
from tapeforms.operators import neighbours, signals, simulator, windows
from tapeforms.plans.settings import settings
from tapeforms.sources.store import BatchLog
from tapeforms.streaming import shapes
from tapeforms.streaming import signals as S

KNN = CONFIG | {"signal_source": "knn_shape", "k": 3, "dedup_gap": 1, "min_matches": 2, "p_threshold": 0.6, "t_multiplier": 0.5, "enable_shorts": "true"}
FIGURES = ["mean", "median", "pct_positive", "uncond_mean", "threshold"]


def plain(df):
    return sorted(map(str, df.select(*(F.round(c, 9).alias(c) if c in FIGURES else F.col(c).cast("string") for c in sorted(df.columns))).collect()))


@pytest.mark.parametrize("few", [neighbours.FEW, 5])
def test_knn_signals_and_decisions_of_a_stream_equal_those_of_the_batch(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(neighbours, "FEW", few)
    bars = two_symbols(spark)
    x = B.indexed(B.regular_hours(bars)).cache()
    s = settings(KNN)
    folder = str(tmp_path / "k")
    for stream in in_parts(spark, bars, folder, (0, 30, 33, 41, 200)):
        shapes.start(stream, s, folder, merge_every=1, availableNow=True).awaitTermination()
        with S.rocks(spark):
            out = shapes.decided(spark, folder, s, 1, 10_000.0)
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()
    batch = signals.signals(x, s)
    got = shapes.given(spark, folder).select(*batch.columns)
    assert plain(got) == plain(batch)
    assert {"LONG", "SHORT", "NO_TRADE"} == {r.direction for r in batch.collect()} and {"rule", "too_few_matches", "no_window"} <= {r.reason for r in batch.collect()}
    want = simulator.replay(x, batch, s, 1, 10_000.0)
    assert sorted(map(str, spark.read.parquet(f"{folder}/out").select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {"entry", "hold"} <= {r.outcome for r in want.collect()}


def test_few_queries_have_the_neighbours_of_the_batch_engine(spark):
    x = B.indexed(B.regular_hours(two_symbols(spark)))
    for window, k in ((2, 3), (4, 5)):  # windows of two bars have two shapes, so nearly all distances are ties
        w = windows.windows(x, window, 2).cache()
        queries = w.where("valid and end_idx % 3 = 0").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz"))
        want = neighbours.nearest_by_blocks(w, queries, window, 2, k)
        few = neighbours.nearest_of_few(w, queries, window, 2, k, window).select(*want.columns)
        assert sorted(map(str, few.collect())) == sorted(map(str, want.collect())) and want.count() > 100
        usual = neighbours.unconditional(w, window, 2).join(queries.select("symbol", "q_end"), ["symbol", "q_end"]).where("n_candidates > 0")
        of_few = neighbours.unconditional_of_few(w, queries, window, 2)
        assert {(r.symbol, r.q_end, r.n_candidates, round(r.uncond_mean, 12)) for r in of_few.collect()} == {(r.symbol, r.q_end, r.n_candidates, round(r.uncond_mean, 12)) for r in usual.collect()}


def test_without_bars_there_are_no_signals(spark, tmp_path):
    none = spark.createDataFrame([], BARS)
    none.write.parquet(str(tmp_path / "in"))
    shapes.start(spark.readStream.schema(none.schema).parquet(str(tmp_path / "in")), settings(KNN), str(tmp_path / "k"), availableNow=True).awaitTermination()
    assert shapes.given(spark, str(tmp_path / "k")).count() == 0
    with pytest.raises(ValueError):
        shapes.shaped(none, settings(KNN | {"features": "ohlc"}))


def test_a_log_by_batches(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"), "x long", merge_every=3)
    assert log.read().count() == 0
    for batch in range(12):
        for _ in range(1 + batch % 2):  # every other one is run again
            log.append(spark.createDataFrame([(batch,), (100 + batch,)], "x long"), batch)
        assert sorted(r.x for r in log.read().collect()) == [*range(batch + 1), *range(100, 101 + batch)]
        assert sorted(r.x for r in log.read(batch).collect()) == [batch, 100 + batch]
    assert len(log._parts()) <= 6 and len([p for p in (tmp_path / "log").iterdir() if p.name.split("-")[0] == p.name.split("-")[1]]) <= 7
