"""Signal sources: from bars to one row per bar with a direction and the reason for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeforms.functions import candles, templates
from tapeforms.operators import bars as B
from tapeforms.operators import neighbours, windows
from tapeforms.plans.settings import OF_SOURCE, Settings

COLUMNS = ["symbol", "session", "idx", "ts", "direction", "reason"]
SOURCES: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {}


def register(name: str) -> Callable:
    """Adds a source: a function from indexed bars and settings to signals. Its settings must be known to the identity hash."""
    if name not in OF_SOURCE:
        raise ValueError(f"{name!r} has no identity fields")

    def add(f: Callable[[DataFrame, Settings], DataFrame]) -> Callable[[DataFrame, Settings], DataFrame]:
        SOURCES[name] = f
        return f

    return add


def signals(indexed: DataFrame, settings: Settings) -> DataFrame:
    if settings.signal_source not in SOURCES:
        raise KeyError(f"unknown signal source {settings.signal_source!r}")
    return SOURCES[settings.signal_source](indexed, settings)


def _with_window(indexed: DataFrame, s: Settings, per_window: DataFrame) -> DataFrame:
    """Each bar with the columns of the window that is current at it; null where there is none yet."""
    return windows.current_window(indexed, s.window).join(per_window, ["symbol", "q_end"], "left")


KNN_FIGURES = ["q_end", "n", "mean", "median", "pct_positive", "n_candidates", "uncond_mean", "threshold"]


def knn_verdict(out: DataFrame, s: Settings) -> DataFrame:
    """Bars with what followed the shapes like their current window's (valid null: no window yet), and the direction and reason that follow."""
    few = F.coalesce(F.col("n"), F.lit(0)) < s.min_matches
    threshold = F.round(s.t_multiplier * F.col("uncond_mean"), 12)
    long = (F.col("pct_positive") >= s.p_threshold) & (F.round("mean", 12) >= threshold)
    short = F.lit(s.enable_shorts) & (1 - F.col("pct_positive") >= s.p_threshold) & (F.round("mean", 12) <= -threshold)
    direction = F.when(F.col("valid").isNull() | ~F.col("valid") | few, "NO_TRADE").when(long, "LONG").when(short, "SHORT").otherwise("NO_TRADE")
    reason = F.when(F.col("valid").isNull(), "no_window").when(~F.col("valid"), "degenerate_window").when(few, "too_few_matches").otherwise("rule")
    judged = out.withColumns({"direction": direction, "reason": reason, "_threshold": threshold})
    shown = F.col("reason") == "rule"
    return judged.withColumns({"n": F.when(F.col("valid"), F.coalesce(F.col("n"), F.lit(0))), "threshold": F.when(shown, F.col("_threshold")), "n_candidates": F.when(shown, F.col("n_candidates")), "uncond_mean": F.when(shown, F.col("uncond_mean"))}).drop("_threshold")


@register("knn_shape")
def knn_shape(indexed: DataFrame, s: Settings) -> DataFrame:
    """LONG or SHORT where enough of the nearest past shapes went one way and by enough; with the figures of the match."""
    w = windows.windows(indexed, s.window, s.horizon, s.features, s.normalization)
    queries = w.where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz"))
    near = neighbours.nearest_by_blocks(w, queries, s.window, s.horizon, s.k)
    stats = neighbours.match_stats(neighbours.without_overlaps(near, s.k, s.dedup_gap))
    per = w.select("symbol", F.col("end_idx").alias("q_end"), "valid").join(neighbours.unconditional(w, s.window, s.horizon), ["symbol", "q_end"]).join(stats, ["symbol", "q_end"], "left")
    return knn_verdict(_with_window(indexed, s, per), s).select(*COLUMNS, *KNN_FIGURES)


def template_table(indexed: DataFrame, s: Settings) -> DataFrame:
    """(name, direction, ord, t): the enabled templates, at most the library's, as vectors like those of the windows."""
    zscore = s.normalization == "logret_zscore"
    rows = [(n, d, i, templates.template_vector(a, s.window, zscore)) for i, (n, d, a) in enumerate(templates.chosen(s.template_patterns))]
    return indexed.sparkSession.createDataFrame(rows, "name string, direction string, ord int, t array<double>")


def template_distances(w: DataFrame, table: DataFrame) -> DataFrame:
    """(symbol, q_end, name, direction, ord, dist) of each valid window with each template."""
    squares = F.aggregate(F.zip_with("z", "t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
    return w.where("valid").crossJoin(F.broadcast(table)).select("symbol", F.col("end_idx").alias("q_end"), "name", "direction", "ord", F.round(F.sqrt(squares), neighbours.DIGITS).alias("dist"))


def with_template_figures(rows: DataFrame, s: Settings) -> DataFrame:
    """rows (z, valid, …) with pattern, distance, n_matched, any_long, any_short and matched of each valid window, without a join."""
    zscore = s.normalization == "logret_zscore"

    def dist(t: list[float]) -> Column:
        squares = F.aggregate(F.zip_with("z", F.array(*(F.lit(v) for v in t)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
        return F.round(F.sqrt(squares), neighbours.DIGITS)

    near = F.array(*(F.struct(dist(templates.template_vector(a, s.window, zscore)).alias("dist"), F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(d).alias("direction")) for i, (n, d, a) in enumerate(templates.chosen(s.template_patterns))))
    best, met = F.array_min("_near"), F.filter("_near", lambda x: x["dist"] <= s.template_threshold)
    out = rows.withColumn("_near", F.when(F.col("valid"), near)).withColumns({"_best": best, "_met": met})
    sides = {f"any_{d.lower()}": F.array_contains(F.transform("_met", lambda x: x["direction"]), d) for d in ("LONG", "SHORT")}
    return out.withColumns({"pattern": F.col("_best.name"), "distance": F.col("_best.dist"), "n_matched": F.when(F.col("_met").isNotNull(), F.size("_met")), "matched": F.transform("_met", lambda x: x["name"]), **sides}).drop("_near", "_best", "_met")


def template_verdict(out: DataFrame, s: Settings) -> DataFrame:
    """Bars with the figures of their current window (all null: none), and the direction and reason that follow."""
    ready = F.col("valid")
    verdict = F.when(F.col("n_matched") == 0, "too_far").when(F.col("any_long") & F.col("any_short"), "conflict").when(F.col("any_short") & F.lit(not s.enable_shorts), "shorts_disabled").otherwise("rule")
    reason = F.when(ready.isNull(), "no_window").when(~ready, "degenerate_window").otherwise(verdict)
    direction = F.when(F.col("reason") == "rule", F.when(F.col("any_long"), "LONG").otherwise("SHORT")).otherwise("NO_TRADE")
    return out.withColumn("reason", reason).withColumn("direction", direction)


@register("template")
def template(indexed: DataFrame, s: Settings) -> DataFrame:
    """The direction of the templates within the threshold, where they agree; pattern is the nearest, near or not."""
    if s.features != "close":
        raise ValueError("templates are drawn on closes")
    w = windows.windows(indexed, s.window, s.horizon, "close", s.normalization)
    per = with_template_figures(w.select("symbol", F.col("end_idx").alias("q_end"), "z", "valid"), s).drop("z")
    return template_verdict(_with_window(indexed, s, per), s).select(*COLUMNS, "q_end", "pattern", "distance", "n_matched", "matched")


def with_candles(indexed: DataFrame) -> tuple[DataFrame, list[candles.Candle]]:
    """indexed bars with the prices of the two bars before in the session, and the candles 0, 1 and 2 bars ago."""
    order = W.partitionBy("symbol", "session").orderBy("idx")
    rows = indexed.withColumns({f"_{c}{back}": F.lag(c, back).over(order) for back in (1, 2) for c in B.PRICES})
    return rows, [candles.Candle(*(F.col(c if back == 0 else f"_{c}{back}") for c in B.PRICES)) for back in (0, 1, 2)]


def fires(pattern: candles.Pattern, ago: list[candles.Candle]) -> Column:
    """Whether a pattern ends at the bar; false where its bars are not all in the session."""
    return F.coalesce(pattern.fires(*reversed(ago[: pattern.bars])), F.lit(False))


def in_trend(pattern: candles.Pattern, lookback: int, close_ago: Callable[[int], Column] | None = None) -> Column:
    """Whether closes before the pattern moved against its direction over `lookback` bars; false without enough bars. close_ago(n): the close n bars ago in the session."""
    if lookback <= 0:
        return F.lit(True)
    order = W.partitionBy("symbol", "session").orderBy("idx")
    close_ago = close_ago or (lambda n: F.lag("close", n).over(order))
    before, start = close_ago(pattern.bars), close_ago(pattern.bars - 1 + lookback)
    return F.coalesce(before < start if pattern.direction == "LONG" else before > start, F.lit(False))


def candle_verdict(rows: DataFrame, ago: list[candles.Candle], s: Settings, close_ago: Callable[[int], Column] | None = None) -> DataFrame:
    """Bars with matched, the patterns that end there, and the direction and reason that follow."""
    enabled = candles.chosen(s.candle_patterns)
    rows = rows.withColumns({f"_fired_{p.name}": fires(p, ago) & in_trend(p, s.candle_trend_lookback, close_ago) for p in enabled})
    rows = rows.withColumn("matched", F.filter(F.array(*(F.when(F.col(f"_fired_{p.name}"), F.lit(p.name)) for p in enabled)), lambda x: x.isNotNull())).drop(*(f"_fired_{p.name}" for p in enabled))

    def any_of(direction: str) -> Column:
        return F.arrays_overlap("matched", F.array(*(F.lit(p.name) for p in enabled if p.direction == direction)).cast("array<string>"))

    verdict = F.when(F.size("matched") == 0, "no_pattern").when(any_of("LONG") & any_of("SHORT"), "conflict").when(any_of("SHORT") & F.lit(not s.enable_shorts), "shorts_disabled").otherwise("rule")
    out = rows.withColumn("reason", verdict)
    direction = F.when(F.col("reason") == "rule", F.when(any_of("LONG"), "LONG").otherwise("SHORT")).otherwise("NO_TRADE")
    return out.withColumn("direction", direction)


@register("candles")
def candle(indexed: DataFrame, s: Settings) -> DataFrame:
    """The direction of the candlestick patterns that end at the bar, where they agree; pattern is the first in order."""
    return candle_verdict(*with_candles(indexed), s).select(*COLUMNS, F.get(F.col("matched"), F.lit(0)).alias("pattern"), F.size("matched").alias("n_matched"), "matched")
