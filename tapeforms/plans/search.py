"""Queries of the exact searches and of the as-of join, with their SQL; they join the catalog's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeforms.operators import asof, diagonals, neighbours, shape_index, windows
from tapeforms.plans import catalog as C

TIES = (2, 3, 5, 2)  # windows of two bars have two shapes, so nearly all distances are ties


def shapes(spark: SparkSession, sf_dir: str, window: int, horizon: int, minutes: int = C.MINUTES) -> DataFrame:
    return windows.windows(C.bars(spark, sf_dir, minutes), window, horizon)


def by_blocks(w: DataFrame, window: int, horizon: int, k: int) -> DataFrame:
    return neighbours.nearest_by_blocks(w, w.where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz")), window, horizon, k)


C.query("knn_topk_ties", f"WITH {C._pairs_sql(*TIES)} SELECT {C.NEAR_COLUMNS} FROM near")(lambda s, d: C.shown(by_blocks(shapes(s, d, *TIES[:2]), *TIES[:3])))
C.query("knn_topk_index", f"WITH {C.PAIRS_SQL} SELECT {C.NEAR_COLUMNS} FROM near")(lambda s, d: C.shown(shape_index.nearest_by_index(C.all_windows(s, d), C.W, C.H, C.K, C.W).drop("met")))
C.query("knn_topk_diagonals", f"WITH {C._pairs_sql(*C.WIDE, 5)} SELECT {C.NEAR_COLUMNS.replace('round(dist', 'round(dist + 1e-10')} FROM near")(
    lambda s, d: C.shown(diagonals.nearest_by_diagonals(C.bars(s, d, 5), *C.WIDE[:3]).withColumn("dist", F.col("dist") + 1e-10))
)


@C.query("knn_index_pairs")
def knn_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pairs of a 1-minute window and one that it may look at, how many the index computes."""
    w = shapes(spark, sf_dir, C.W, C.H, 1)
    found = shape_index.nearest_by_index(w, C.W, C.H, C.K, C.W)
    return shape_index.computed_share(found, w, neighbours.unconditional(w, C.W, C.H))


@C.query("asof_join", f"WITH {C.BARS_SQL} SELECT e.event_id, x.idx, x.ts::VARCHAR AS bar_ts, {C.num('x.close', 'close')} FROM events e ASOF LEFT JOIN x ON e.ts >= x.ts")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bar in regular hours that began last at the time of each event."""
    times = C.table(spark, sf_dir, "events").select("event_id", F.lit("EVT").alias("symbol"), "ts")
    bars = C.bars(spark, sf_dir).select("symbol", "ts", "idx", "close")
    return C.shown(asof.asof(times, bars).select("event_id", "found.idx", F.col("found.ts").alias("bar_ts"), "found.close"))
