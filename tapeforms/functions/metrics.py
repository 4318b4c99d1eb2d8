"""Statistics of returns and curves. Missing values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sharpe(returns: Column | str, periods: Column | float) -> Column:
    """Mean over sample standard deviation, times the root of the periods a year; null below two values or without spread."""
    spread = F.stddev_samp(returns)
    return F.when((F.count(returns) >= 2) & (spread > 0), F.avg(returns) / spread * F.sqrt(periods if isinstance(periods, Column) else F.lit(float(periods))))


def hit_rate(returns: Column | str) -> Column:
    r = F.col(returns) if isinstance(returns, str) else returns
    return F.avg(F.when(r.isNotNull(), (r > 0).cast("double")))


def max_drawdown(curve: DataFrame, value: str, order: str, group: list[str], part: str) -> DataFrame:
    """(group, max_drawdown): the largest fall from a running peak, as a share of it; 0 for an empty curve.

    The running peak is taken in two steps, within each `part` (say a session) and over the parts' own peaks, so that a long
    curve is not one task.
    """
    peaks = curve.groupBy(*group, part).agg(F.max(value).alias("_peak"))
    before = peaks.withColumn("_before", F.max("_peak").over(W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1))).drop("_peak")
    inside = F.max(value).over(W.partitionBy(*group, part).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    peak = F.greatest(F.col("_inside"), F.col("_before"))
    out = curve.withColumn("_inside", inside).join(before, [*group, part])
    return out.groupBy(*group).agg(F.coalesce(F.max((peak - F.col(value)) / peak), F.lit(0.0)).alias("max_drawdown"))
