"""The queries of the library, each with the SQL that gives the same rows.

The given tables have no bars, so all start from 15-minute bars of `events`. Settings are small ones, at which every
branch occurs on such data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeforms.functions import candles, metrics, templates
from tapeforms.operators import backtest, journal, ledger, neighbours, signals, windows
from tapeforms.operators import bars as B
from tapeforms.plans.settings import Settings
from tapeforms.sources import folders
from tapeforms.streaming import live

MINUTES = 15
KNN = Settings(
    signal_source="knn_shape", symbols=("EVT",), window=5, horizon=3, k=5, dedup_gap=2, min_matches=3, min_history_bars=50,
    template_threshold=1.5, candle_trend_lookback=3, enable_shorts=True,
)
TEMPLATE, CANDLE = replace(KNN, signal_source="template"), replace(KNN, signal_source="candles")
CASH = 100_000.0
RESAMPLES = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, minutes: int = MINUTES) -> DataFrame:
    return B.indexed(B.regular_hours(B.from_events(table(spark, sf_dir, "events"), minutes)))


def shown(df: DataFrame) -> DataFrame:
    """Times as text and numbers at six decimals, as the SQL gives them."""

    def plain(name: str, kind: str) -> Column:
        c = F.col(name)
        return (c.cast("string") if kind in ("timestamp_ntz", "timestamp", "date") else F.round(c, 6) + F.lit(0.0) if kind == "double" else c.cast("long") if kind in ("int", "bigint") else c).alias(name)

    return df.select(*(plain(n, k) for n, k in df.dtypes))


def num(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def _bars_sql(minutes: int) -> str:
    return f"""
b AS (
  SELECT 'EVT' AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
  FROM events WHERE value > 0 GROUP BY 2
), n AS (
  SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM b
), r AS (
  SELECT symbol, ts, open, high, low, close, volume, ny::DATE AS session, (hour(ny) * 60 + minute(ny))::BIGINT AS minute
  FROM n WHERE hour(ny) * 60 + minute(ny) BETWEEN 570 AND 959
), x AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts) - 1 AS pos, row_number() OVER (ORDER BY ts) - 1 AS idx,
         count(*) OVER (PARTITION BY session) - row_number() OVER (PARTITION BY session ORDER BY ts) AS bars_left
  FROM r
)"""


BARS_SQL = _bars_sql(MINUTES)
W, H, K, GAP = KNN.window, KNN.horizon, KNN.k, KNN.dedup_gap


def _windows_sql(W: int, H: int, minutes: int = MINUTES) -> str:  # noqa: N803
    return f"""{_bars_sql(minutes)}, ret AS (
  SELECT *, ln(close / lag(close) OVER s) AS r, lead(close, {H}) OVER s / close - 1 AS fwd_ret FROM x WINDOW s AS (PARTITION BY session ORDER BY idx)
), w0 AS (
  SELECT symbol, session, idx AS end_idx, ts AS end_ts, fwd_ret, pos, list(r) OVER (PARTITION BY session ORDER BY idx ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS v FROM ret
), w1 AS (
  SELECT *, list_sum(v) / {W} AS m FROM w0 WHERE pos >= {W}
), w2 AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda q: (q - m) * (q - m))) / {W}) AS sd FROM w1
), w AS (
  SELECT symbol, session, end_idx, end_ts, fwd_ret, v, list_transform(v, lambda q: (q - m) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END) AS z, sd > 1e-12 AS valid FROM w2
), cur AS (
  SELECT *, last_value(CASE WHEN pos >= {W} THEN idx END IGNORE NULLS) OVER (ORDER BY idx) AS q_end FROM x
)"""


def _pairs_sql(W: int, H: int, K: int, GAP: int, minutes: int = MINUTES) -> str:  # noqa: N803
    return f"""{_windows_sql(W, H, minutes)}, pairs AS (
  SELECT q.symbol, q.end_idx AS q_end, c.end_idx, c.end_ts, c.fwd_ret, round(list_distance(q.z, c.z), 9) AS dist
  FROM w q JOIN w c ON c.valid AND c.fwd_ret IS NOT NULL AND c.end_idx + {H} <= q.end_idx - {W} WHERE q.valid
), near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_end ORDER BY dist, end_idx) AS rank FROM pairs) WHERE rank <= {5 * K}
), folded AS (
  SELECT q_end, list_reduce(list(end_idx ORDER BY rank), lambda acc, e: CASE WHEN len(acc) >= {K} OR len(list_filter(acc, lambda y: abs(y - e) <= {GAP})) > 0 THEN acc ELSE list_append(acc, e) END, []::BIGINT[]) AS kept
  FROM near GROUP BY q_end
), kept AS (
  SELECT n.symbol, n.q_end, list_position(f.kept, n.end_idx)::BIGINT AS kept_rank, n.rank, n.end_idx, n.end_ts, n.dist, n.fwd_ret
  FROM near n JOIN folded f ON n.q_end = f.q_end WHERE list_contains(f.kept, n.end_idx)
), stats AS (
  SELECT symbol, q_end, count(*) AS n, avg(fwd_ret) AS mean, median(fwd_ret) AS median, avg((fwd_ret > 0)::INT) AS pct_positive FROM kept GROUP BY 1, 2
), uncond AS (
  SELECT symbol, end_idx AS q_end, count(u) OVER f AS n_candidates, avg(u) OVER f AS uncond_mean
  FROM (SELECT *, CASE WHEN valid THEN fwd_ret END AS u FROM w) WINDOW f AS (ORDER BY end_idx RANGE BETWEEN UNBOUNDED PRECEDING AND {W + H} PRECEDING)
)"""


WINDOWS_SQL, PAIRS_SQL = _windows_sql(W, H), _pairs_sql(W, H, K, GAP)
KNN_SQL = f"""{PAIRS_SQL}, ks AS (
  SELECT c.symbol, c.session, c.idx, c.ts, c.q_end, w.valid, CASE WHEN w.valid THEN coalesce(s.n, 0) END AS n, s.mean, s.median, s.pct_positive, u.n_candidates, u.uncond_mean,
         round({KNN.t_multiplier} * u.uncond_mean, 12) AS threshold,
         CASE WHEN w.valid IS NULL THEN 'no_window' WHEN NOT w.valid THEN 'degenerate_window' WHEN coalesce(s.n, 0) < {KNN.min_matches} THEN 'too_few_matches' ELSE 'rule' END AS reason
  FROM cur c LEFT JOIN w ON w.end_idx = c.q_end LEFT JOIN stats s ON s.q_end = c.q_end LEFT JOIN uncond u ON u.q_end = c.q_end
), knn AS (
  SELECT symbol, session, idx, ts, q_end, reason, n, mean, median, pct_positive,
         CASE WHEN reason = 'rule' THEN n_candidates END AS n_candidates, CASE WHEN reason = 'rule' THEN uncond_mean END AS uncond_mean, CASE WHEN reason = 'rule' THEN threshold END AS threshold,
         CASE WHEN reason <> 'rule' THEN 'NO_TRADE' WHEN pct_positive >= {KNN.p_threshold} AND round(mean, 12) >= threshold THEN 'LONG'
              WHEN 1 - pct_positive >= {KNN.p_threshold} AND round(mean, 12) <= -threshold THEN 'SHORT' ELSE 'NO_TRADE' END AS direction
  FROM ks
)"""


def _templates_sql() -> str:
    rows = ", ".join(f"('{n}', '{d}', {i}, {templates.template_vector(a, W)})" for i, (n, d, a) in enumerate(templates.chosen(KNN.template_patterns)))
    met = f"dist <= {TEMPLATE.template_threshold}"
    return f"""{WINDOWS_SQL}, tpl(name, direction, ord, t) AS (VALUES {rows}), td AS (
  SELECT w.symbol, w.end_idx AS q_end, name, direction, ord, round(list_distance(w.z, t::DOUBLE[]), 9) AS dist FROM w, tpl WHERE w.valid
), tw AS (
  SELECT symbol, q_end, arg_min(name, (dist, ord)) AS pattern, min(dist) AS distance, count(*) FILTER ({met}) AS n_matched,
         coalesce(bool_or({met} AND direction = 'LONG'), false) AS any_long, coalesce(bool_or({met} AND direction = 'SHORT'), false) AS any_short,
         coalesce(string_agg(CASE WHEN {met} THEN name END, ',' ORDER BY ord), '') AS matched
  FROM td GROUP BY 1, 2
), tr AS (
  SELECT c.symbol, c.session, c.idx, c.ts, c.q_end, tw.* EXCLUDE (symbol, q_end),
         CASE WHEN w.valid IS NULL THEN 'no_window' WHEN NOT w.valid THEN 'degenerate_window' WHEN n_matched = 0 THEN 'too_far' WHEN any_long AND any_short THEN 'conflict' ELSE 'rule' END AS reason
  FROM cur c LEFT JOIN w ON w.end_idx = c.q_end LEFT JOIN tw ON tw.q_end = c.q_end
), template AS (
  SELECT *, CASE WHEN reason <> 'rule' THEN 'NO_TRADE' WHEN any_long THEN 'LONG' ELSE 'SHORT' END AS direction FROM tr
)"""


TEMPLATE_SQL = _templates_sql()


def _candle(back: int) -> dict[str, str]:
    o, h, lo, c = (f"{x}{back or ''}" for x in ("open", "high", "low", "close"))
    return {"o": o, "c": c, "body": f"abs({c} - {o})", "rng": f"({h} - {lo})", "up": f"({h} - greatest({o}, {c}))", "dn": f"(least({o}, {c}) - {lo})", "bull": f"({c} > {o})", "bear": f"({c} < {o})", "mid": f"(({o} + {c}) / 2)", "top": f"greatest({o}, {c})", "bot": f"least({o}, {c})"}


D, C, A = _candle(0), _candle(1), _candle(2)  # this bar, the one before, the one before that
FIRES_SQL = {
    "hammer": f"{D['body']} > 0 AND {D['dn']} >= 2 * {D['body']} AND {D['up']} <= {D['body']}",
    "shooting_star": f"{D['body']} > 0 AND {D['up']} >= 2 * {D['body']} AND {D['dn']} <= {D['body']}",
    "bullish_engulfing": f"{C['bear']} AND {D['bull']} AND close >= open1 AND open <= close1 AND {D['body']} > {C['body']}",
    "bearish_engulfing": f"{C['bull']} AND {D['bear']} AND open >= close1 AND close <= open1 AND {D['body']} > {C['body']}",
    "piercing_line": f"{C['bear']} AND {D['bull']} AND open < close1 AND {C['mid']} < close AND close < open1",
    "dark_cloud_cover": f"{C['bull']} AND {D['bear']} AND open > close1 AND open1 < close AND close < {C['mid']}",
    "morning_star": f"{A['bear']} AND {A['rng']} > 0 AND {C['rng']} > 0 AND {A['body']} >= 0.5 * {A['rng']} AND {C['body']} <= 0.3 * {C['rng']} AND {C['top']} < close2 AND {D['bull']} AND close > {A['mid']}",
    "evening_star": f"{A['bull']} AND {A['rng']} > 0 AND {C['rng']} > 0 AND {A['body']} >= 0.5 * {A['rng']} AND {C['body']} <= 0.3 * {C['rng']} AND {C['bot']} > close2 AND {D['bear']} AND close < {A['mid']}",
    "three_white_soldiers": f"{A['bull']} AND {C['bull']} AND {D['bull']} AND close1 > close2 AND close > close1 AND close2 > open1 AND open1 > open2 AND close1 > open AND open > open1",
    "three_black_crows": f"{A['bear']} AND {C['bear']} AND {D['bear']} AND close1 < close2 AND close < close1 AND close2 < open1 AND open1 < open2 AND close1 < open AND open < open1",
}
LAGS_SQL = f"""{BARS_SQL}, lags AS (
  SELECT *, {", ".join(f"lag({c}, {i}) OVER s AS {c}{i}" for i in (1, 2) for c in B.PRICES)}, {", ".join(f"lag(close, {i}) OVER s AS c_{i}" for i in range(1, 6))}
  FROM x WINDOW s AS (PARTITION BY session ORDER BY idx)
)"""


def _candles_sql() -> str:
    look = CANDLE.candle_trend_lookback
    trend = {p.name: f"c_{p.bars} {'<' if p.direction == 'LONG' else '>'} c_{p.bars - 1 + look}" for p in candles.CANDLES.values()}
    fired = ", ".join(f"CASE WHEN ({FIRES_SQL[n]}) AND ({trend[n]}) THEN '{n}' END" for n in candles.CANDLES)
    sides = {d: ", ".join(f"'{p.name}'" for p in candles.CANDLES.values() if p.direction == d) for d in ("LONG", "SHORT")}
    return f"""{LAGS_SQL}, fired AS (
  SELECT symbol, session, idx, ts, list_filter([{fired}], lambda f: f IS NOT NULL) AS m FROM lags
), sided AS (
  SELECT *, len(list_intersect(m, [{sides["LONG"]}])) > 0 AS any_long, len(list_intersect(m, [{sides["SHORT"]}])) > 0 AS any_short FROM fired
), candle AS (
  SELECT symbol, session, idx, ts, CASE WHEN len(m) > 0 THEN m[1] END AS pattern, len(m) AS n_matched, array_to_string(m, ',') AS matched,
         CASE WHEN len(m) = 0 THEN 'no_pattern' WHEN any_long AND any_short THEN 'conflict' ELSE 'rule' END AS reason,
         CASE WHEN len(m) = 0 OR (any_long AND any_short) THEN 'NO_TRADE' WHEN any_long THEN 'LONG' ELSE 'SHORT' END AS direction
  FROM sided
)"""


CANDLE_SQL = _candles_sql()
COST = KNN.cost_bps * 1e-4


def _walk_sql(base: str, source: str) -> str:
    """asked, trades and curve of a source's signals; it needs WITH RECURSIVE."""
    return f"""{base}, live AS (
  SELECT x.session, x.idx, s.direction FROM x JOIN {source} s ON s.idx = x.idx WHERE x.idx >= {KNN.min_history_bars} AND x.bars_left >= {H + 1}
), longs AS (
  SELECT session, idx FROM live WHERE direction = 'LONG'
), nxt AS (
  SELECT a.session, a.idx, min(b.idx) AS n FROM longs a LEFT JOIN longs b ON b.session = a.session AND b.idx >= a.idx + {1 + H} GROUP BY 1, 2
), taken AS (
  SELECT session, min(idx) AS idx FROM longs GROUP BY 1 UNION ALL SELECT t.session, n.n FROM taken t JOIN nxt n ON n.session = t.session AND n.idx = t.idx WHERE n.n IS NOT NULL
), asked AS (
  SELECT l.* FROM live l WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.session = l.session AND l.idx > t.idx AND l.idx < t.idx + {1 + H})
), ahead AS (
  SELECT idx, close AS signal_close, lead(open, 1) OVER s AS o1, lead(open, {1 + H}) OVER s AS o2 FROM x WINDOW s AS (PARTITION BY session ORDER BY idx)
), trades AS (
  SELECT 'EVT' AS symbol, t.session, t.idx AS signal_idx, t.idx + 1 AS entry_idx, t.idx + {1 + H} AS exit_idx, signal_close, o1 * (1 + {COST}) AS entry_price, o2 * (1 - {COST}) AS exit_price,
         o2 / o1 - 1 AS gross_ret, o2 * (1 - {COST}) / (o1 * (1 + {COST})) - 1 AS net_ret, 'time_stop' AS exit_reason
  FROM taken t JOIN ahead a ON a.idx = t.idx
), moved AS (
  SELECT *, 1 + {KNN.position_size} / signal_close * (exit_price - entry_price) AS g FROM trades
), curve AS (
  SELECT x.symbol, x.session, x.idx, x.ts, x.close, {CASH} * coalesce((SELECT product(g) FROM moved m WHERE m.exit_idx <= x.idx), 1) AS base,
         (SELECT max(entry_idx) FROM moved m WHERE m.entry_idx <= x.idx AND m.exit_idx > x.idx) AS held FROM x
), equity AS (
  SELECT c.symbol, c.session, c.idx, c.ts, CASE WHEN held IS NULL THEN base ELSE base * (1 + {KNN.position_size} / m.signal_close * (c.close - m.entry_price)) END AS equity
  FROM curve c LEFT JOIN moved m ON m.entry_idx = c.held
)"""


TRADE_COLUMNS = f"symbol, session::VARCHAR AS session, signal_idx, entry_idx, exit_idx, {num('signal_close', 'signal_close')}, {num('entry_price', 'entry_price')}, {num('exit_price', 'exit_price')}, {num('gross_ret', 'gross_ret')}, {num('net_ret', 'net_ret')}, exit_reason"
SHARPE_SQL = "CASE WHEN count({0}) >= 2 AND stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt({1}) END"


def _falls_sql(of: str, value: str) -> str:
    return f"(SELECT max((peak - v) / peak) FROM (SELECT {value} AS v, max({value}) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS peak FROM {of}))"


def _summary_sql(base: str, source: str) -> str:
    return f"""WITH RECURSIVE {_walk_sql(base, source)}, s AS (SELECT count(DISTINCT session) AS n FROM x), a AS (SELECT count(*) AS q, count(*) FILTER (direction = 'LONG') AS l FROM asked)
SELECT 'EVT' AS symbol, (SELECT n FROM s) AS n_sessions, {num(f"(SELECT arg_max(equity, idx) FROM equity) / {CASH} - 1", "total_return")}, {num(_falls_sql("equity", "equity"), "max_drawdown")},
       (SELECT q FROM a) AS n_signals, (SELECT l FROM a) AS n_long_signals, count(*) AS n_trades, count(*) FILTER (exit_reason = 'force_flat') AS n_force_flat,
       {num("avg((net_ret > 0)::INT)", "hit_rate")}, {num("avg(net_ret)", "mean_net_ret")}, {num(SHARPE_SQL.format("net_ret", "count(*) / ((SELECT n FROM s) / 252.0)"), "sharpe")}
FROM trades"""


def walk(spark: SparkSession, sf_dir: str, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = folders.cut(bars(spark, sf_dir))  # both are used several times, and small next to what they come from
    asked = folders.cut(backtest.asked(signals.signals(x, s), x, s))
    return x, asked, backtest.trades(asked, x, s)


def all_windows(spark: SparkSession, sf_dir: str, features: str = "close", normalization: str = "logret_zscore") -> DataFrame:
    return windows.windows(bars(spark, sf_dir), W, H, features, normalization)


def spread(df: DataFrame, column: str, width: int) -> DataFrame:
    """An array of fixed width as columns."""
    return df.select(*(c for c in df.columns if c not in ("x", "z")), *(F.col(column)[i].alias(f"{column}{i}") for i in range(width)))


def pairs_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = all_windows(spark, sf_dir)
    return w, neighbours.distances(w, w.where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz")), W, H, W)


def kept_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.without_overlaps(neighbours.nearest(pairs_of(spark, sf_dir)[1], K), K, GAP)


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = all_windows(spark, sf_dir)
    return neighbours.nearest_by_blocks(w, w.where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz")), W, H, K, block=256, chunk=128)


def wide_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    window, horizon, k, _ = WIDE
    w = windows.windows(bars(spark, sf_dir, 5), window, horizon)
    return neighbours.nearest_by_blocks(w, w.where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz")), window, horizon, k)


# Inputs for the journal and the ledger, derived from events, in both dialects.
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    number = lambda c: c.cast("string")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), F.concat(F.lit("c"), number(F.col("user_id") % 17)).alias("config_hash"), F.when(e % 5 == 0, "match").otherwise("backtest").alias("run_type"), F.when(e % 7 == 0, "crashed").otherwise("ok").alias("status"), e.alias("started_at"),
        F.concat(F.lit('{"mean_net_ret": '), number((e * 37) % 2001 - 1000), F.lit(', "p_random": 0.0'), F.lpad(number((e * 13) % 10000), 4, "0"), F.lit("}")).alias("metrics_json"),
    )


RUNS_SQL = """runs AS (
  SELECT event_id AS id, 'c' || (user_id % 17) AS config_hash, CASE WHEN event_id % 5 = 0 THEN 'match' ELSE 'backtest' END AS run_type, CASE WHEN event_id % 7 = 0 THEN 'crashed' ELSE 'ok' END AS status, event_id AS started_at,
         '{"mean_net_ret": ' || ((event_id * 37) % 2001 - 1000) || ', "p_random": 0.0' || lpad(((event_id * 13) % 10000)::VARCHAR, 4, '0') || '}' AS metrics_json FROM events
), tried AS (SELECT count(DISTINCT config_hash) AS n, 0.05 / greatest(count(DISTINCT config_hash), 1) AS alpha FROM runs WHERE run_type = 'backtest')"""


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spent when event_id is even, finished by the event after it unless that is a multiple of 3."""
    e = F.col("event_id")
    done = F.when((e % 2 == 1) & (e % 3 != 0), F.when(e % 5 == 0, "SURVIVED").otherwise("REJECTED"))
    return table(spark, sf_dir, "events").select(F.floor(e / 2).alias("evaluation_id"), F.concat(F.lit("c"), (F.floor(e / 2) % 29).cast("string")).alias("config_hash"), e.alias("seq"), done.alias("verdict"))


VERDICTS_SQL = """ev AS (
  SELECT event_id // 2 AS evaluation_id, 'c' || ((event_id // 2) % 29) AS config_hash,
         CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN 'SURVIVED' ELSE 'REJECTED' END END AS verdict FROM events
), vd AS (SELECT evaluation_id, any_value(config_hash) AS config_hash, coalesce(max(verdict), 'CRASHED') AS verdict FROM ev GROUP BY 1)"""


def journal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    intent = F.when((e * 7919) % 10 < 5, "entry").when(e % 3 == 0, "force_flat").otherwise("time_stop")
    state = F.when(e % 11 == 0, "rejected").when(e % 13 == 0, "open").otherwise("filled")
    return table(spark, sf_dir, "events").select(e.alias("broker_order_id"), F.col("event_type").alias("symbol"), intent.alias("intent"), (e % 50 + 1).cast("double").alias("qty"), state.alias("status"), (F.col("value") + 1).alias("filled_avg_price"), F.col("ts").alias("filled_at"), F.floor(e / 2).alias("signal_id"), e.alias("submitted_at"))


ORDERS_SQL = """jo AS (
  SELECT event_id AS broker_order_id, event_type AS symbol, CASE WHEN (event_id * 7919) % 10 < 5 THEN 'entry' WHEN event_id % 3 = 0 THEN 'force_flat' ELSE 'time_stop' END AS intent, (event_id % 50 + 1)::DOUBLE AS qty,
         CASE WHEN event_id % 11 = 0 THEN 'rejected' WHEN event_id % 13 = 0 THEN 'open' ELSE 'filled' END AS status, value + 1 AS filled_avg_price, ts AS filled_at, event_id // 2 AS signal_id, event_id AS submitted_at FROM events
), paired AS (
  SELECT * FROM (SELECT symbol, lag(filled_at) OVER s AS entry_ts, filled_at AS exit_ts, lag(qty) OVER s AS qty, lag(filled_avg_price) OVER s AS entry_price, filled_avg_price AS exit_price, lag(intent) OVER s AS before, intent AS exit_reason
  FROM jo WHERE status = 'filled' WINDOW s AS (PARTITION BY symbol ORDER BY filled_at, broker_order_id)) WHERE before = 'entry' AND exit_reason <> 'entry'
), tr AS (SELECT *, exit_price / entry_price - 1 AS net_ret, qty * (exit_price - entry_price) AS pnl FROM paired)"""


def journal_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where(e % 2 == 0).select(F.floor(e / 2).alias("id"), F.concat(F.lit("c"), (e % 7).cast("string")).alias("config_hash"), e.alias("signal_ts"), F.lit("new").alias("status"))


SIGNALS_SQL = "js AS (SELECT event_id // 2 AS id, 'c' || (event_id % 7) AS config_hash, event_id AS signal_ts, 'new' AS status FROM events WHERE event_id % 2 = 0)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "ts", (F.lit(50_000.0) + F.col("idx") * 3).alias("equity"))


SNAPSHOTS_SQL = "sn AS (SELECT symbol, ts, 50000.0::DOUBLE + idx * 3 AS equity FROM x), sp AS (SELECT min(ts) AS t0, max(ts) AS t1, arg_min(equity, ts) AS e0, arg_max(equity, ts) AS e1 FROM sn)"


def step_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    at = lambda m, n: F.floor(e / m) % n
    return table(spark, sf_dir, "events").select(
        e.alias("id"), (e % 11 != 0).alias("is_open"), (e % 13 != 0).alias("has_bars"), F.when(at(2, 2) == 0, 0.0).otherwise(7.0).alias("held"), (at(4, 5) == 0).alias("sell_pending"), (at(3, 5) == 0).alias("buy_pending"),
        (at(1, 17) * 2).alias("mins_to_close"), (at(5, 4) != 0).alias("has_entry_record"), at(7, 6).alias("bars_since_entry"), (at(6, 4) == 0).alias("decided"),
        F.when(at(8, 3) == 0, "SHORT").when(at(8, 3) == 1, "NO_TRADE").otherwise("LONG").alias("direction"), F.when(at(9, 5) != 0, F.col("value")).alias("price"), (at(10, 3) * 5000.0).alias("equity"),
    )


STEP_SQL = """cs AS (
  SELECT event_id AS id, event_id % 11 <> 0 AS is_open, event_id % 13 <> 0 AS has_bars, CASE WHEN (event_id // 2) % 2 = 0 THEN 0.0 ELSE 7.0 END AS held, (event_id // 4) % 5 = 0 AS sell_pending, (event_id // 3) % 5 = 0 AS buy_pending,
         (event_id % 17) * 2 AS mins, (event_id // 5) % 4 <> 0 AS has_record, (event_id // 7) % 6 AS since, (event_id // 6) % 4 = 0 AS decided,
         CASE (event_id // 8) % 3 WHEN 0 THEN 'SHORT' WHEN 1 THEN 'NO_TRADE' ELSE 'LONG' END AS direction, CASE WHEN (event_id // 9) % 5 <> 0 THEN value END AS price, ((event_id // 10) % 3) * 5000.0 AS equity FROM events
), ou AS (
  SELECT *, floor(equity * 0.05 / price) AS q, CASE WHEN NOT is_open THEN 'market_closed' WHEN NOT has_bars THEN 'no_bars'
    WHEN held > 0 THEN CASE WHEN sell_pending THEN 'exit_pending' WHEN mins <= 5 THEN 'exit:force_flat' WHEN NOT has_record THEN 'hold:adopted' WHEN since >= 3 THEN 'exit:time_stop' ELSE 'hold' END
    WHEN buy_pending THEN 'entry_pending' WHEN decided THEN 'already_decided' WHEN mins <= 8 THEN 'too_close_to_enter' WHEN direction <> 'LONG' THEN 'no_trade:' || direction
    WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN floor(equity * 0.05 / price) <= 0 THEN 'size_zero' ELSE 'entry' END AS outcome FROM cs
)"""


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What a store holds, and a batch: every third bar again with a later close, and two days that the store lacks."""
    x = bars(spark, sf_dir).withColumn("source", F.lit("feed"))
    columns = ["symbol", "ts", "source", *B.PRICES, "volume", "ingested_at"]
    cut = F.lit("2024-01-29").cast("date")
    old = x.where(F.col("session") < cut).withColumn("ingested_at", F.lit(1)).select(columns)
    return old, x.where((F.col("idx") % 3 == 0) | (F.col("session") >= cut)).withColumns({"ingested_at": F.lit(2), "close": F.col("close") + 1}).select(columns)


STORED_SQL = f"""{BARS_SQL}, old AS (SELECT symbol, ts, 'feed' AS source, open, high, low, close, volume, 1 AS ingested_at FROM x WHERE session < DATE '2024-01-29'),
new AS (SELECT symbol, ts, 'feed' AS source, open, high, low, close + 1 AS close, volume, 2 AS ingested_at FROM x WHERE idx % 3 = 0 OR session >= DATE '2024-01-29')"""


def fired(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows, ago = signals.with_candles(bars(spark, sf_dir))
    return shown(rows.where(signals.fires(candles.CANDLES[name], ago)).select("symbol", "idx", "ts", *B.PRICES))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where("bars_left > 0").select("symbol", F.col("idx").alias("entry_idx"), F.col("open").alias("entry_price"), F.lit(1.0).alias("qty"))


def cases_of_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(e.alias("id"), (e % 9).alias("n_trades"), (F.col("user_id") % 21 - 10).cast("double").alias("mean"), F.when(e % 8 != 0, (e % 100) / 1000).alias("p"), F.lit(0.05).alias("alpha"), F.when(e % 6 != 0, (e % 41 - 20).cast("double")).alias("train_mean"), F.when(e % 10 != 0, (e % 5 - 2).cast("double")).alias("train_sharpe"), (e % 3 - 1).cast("double").alias("test_sharpe"))


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        Q[name] = (f, sql)
        return f

    return add


PRICE_SQL = ", ".join(num(c, c) for c in B.PRICES)
CUT = "2024-01-15 15:07:30"

query("bars_15min", f"WITH {BARS_SQL} SELECT symbol, ts::VARCHAR AS ts, {PRICE_SQL}, volume FROM b")(lambda s, d: shown(B.from_events(table(s, d, "events"), MINUTES)))
query("bars_by_symbol", f"SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts)::VARCHAR AS ts, {num('arg_min(value, ts)', 'open')}, {num('max(value)', 'high')}, {num('min(value)', 'low')}, {num('arg_max(value, ts)', 'close')}, count(*)::DOUBLE AS volume FROM events WHERE value > 0 GROUP BY event_type, time_bucket(INTERVAL '15 minutes', ts)")(lambda s, d: shown(B.from_events(table(s, d, "events"), MINUTES, F.col("event_type"))))
query("rth_filter", f"WITH {BARS_SQL} SELECT symbol, ts::VARCHAR AS ts, {PRICE_SQL}, volume FROM r")(lambda s, d: shown(B.regular_hours(B.from_events(table(s, d, "events"), MINUTES))))
query("upsert_latest", f"WITH {STORED_SQL} SELECT symbol, ts::VARCHAR AS ts, source, {PRICE_SQL}, volume, ingested_at::BIGINT AS ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts, source ORDER BY ingested_at DESC) AS k FROM (FROM old UNION ALL FROM new)) WHERE k = 1")(lambda s, d: shown(B.upsert(*stored(s, d))))
query("ingestion_log", f"WITH {STORED_SQL} SELECT symbol, source, min(ts)::VARCHAR AS start_ts, max(ts)::VARCHAR AS end_ts, count(*) AS n_rows, max(ingested_at)::BIGINT AS fetched_at FROM new GROUP BY 1, 2")(lambda s, d: shown(B.ingestion_log(stored(s, d)[1])))
query("refresh_window", f"WITH {STORED_SQL} SELECT symbol, ts::VARCHAR AS ts, source, {PRICE_SQL}, volume, ingested_at::BIGINT AS ingested_at FROM new WHERE ts >= (SELECT max(ts) FROM old) - INTERVAL 1 DAY")(lambda s, d: shown(B.to_refresh(*stored(s, d))))
query("sessions", f"WITH {BARS_SQL} SELECT symbol, session::VARCHAR AS session, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts, count(*) AS n_bars FROM x GROUP BY symbol, session")(lambda s, d: shown(B.sessions(bars(s, d))))
query("coverage", f"WITH {BARS_SQL}, se AS (SELECT symbol, session, count(*) AS n FROM x GROUP BY 1, 2) SELECT symbol, sum(n)::BIGINT AS n_bars, count(*) AS n_sessions, min(session)::VARCHAR AS first_session, max(session)::VARCHAR AS last_session, count(*) FILTER (n < 25) AS n_short FROM se GROUP BY 1")(lambda s, d: shown(B.coverage(B.sessions(bars(s, d)), 25)))
query("load_bars_until", f"WITH {BARS_SQL} SELECT symbol, ts::VARCHAR AS ts, {PRICE_SQL}, volume FROM r WHERE ts <= TIMESTAMP '{CUT}'")(lambda s, d: shown(B.until(B.regular_hours(B.from_events(table(s, d, "events"), MINUTES)), F.lit(CUT).cast("timestamp_ntz"))))
query("last_bar", f"WITH {BARS_SQL} SELECT symbol, max(ts)::VARCHAR AS last_ts FROM x GROUP BY 1")(lambda s, d: shown(B.last_bar(bars(s, d))))
query("closed_bars", f"WITH {BARS_SQL} SELECT symbol, ts::VARCHAR AS ts, {PRICE_SQL} FROM x WHERE ts <= time_bucket(INTERVAL '{MINUTES} minutes', TIMESTAMP '{CUT}') - INTERVAL '{MINUTES} minutes'")(lambda s, d: shown(B.closed(bars(s, d), F.lit(CUT), MINUTES).select("symbol", "ts", *B.PRICES)))
query("bar_index_bars_left", f"WITH {BARS_SQL} SELECT symbol, ts::VARCHAR AS ts, session::VARCHAR AS session, minute, pos, idx, bars_left FROM x")(lambda s, d: shown(bars(s, d).select("symbol", "ts", "session", "minute", "pos", "idx", "bars_left")))
query("train_test_split", f"WITH {BARS_SQL} SELECT symbol, count(*) FILTER (ts <= TIMESTAMP '2024-01-15 23:59:59') AS n_train, min(idx) FILTER (ts > TIMESTAMP '2024-01-15 23:59:59') AS first_test_idx FROM x GROUP BY 1")(lambda s, d: shown(bars(s, d).groupBy("symbol").agg(F.count_if(F.col("ts") <= F.lit("2024-01-15 23:59:59").cast("timestamp_ntz")).alias("n_train"), F.min(F.when(F.col("ts") > F.lit("2024-01-15 23:59:59").cast("timestamp_ntz"), F.col("idx"))).alias("first_test_idx"))))
query("asof_row", f"WITH {WINDOWS_SQL} SELECT symbol, end_idx, end_ts::VARCHAR AS end_ts, {num('fwd_ret', 'fwd_ret')}, valid FROM w WHERE end_ts <= TIMESTAMP '{CUT}' ORDER BY end_idx DESC LIMIT 1")(lambda s, d: shown(windows.window_at(all_windows(s, d), F.lit(CUT).cast("timestamp_ntz")).select("symbol", "end_idx", "end_ts", "fwd_ret", "valid")))
query("current_window", f"WITH {WINDOWS_SQL} SELECT symbol, idx, q_end FROM cur")(lambda s, d: shown(windows.current_window(bars(s, d), W).select("symbol", "idx", "q_end")))
query("log_returns", f"WITH {WINDOWS_SQL} SELECT symbol, idx, {num('r', 'r0')} FROM ret")(lambda s, d: shown(spread(windows.log_returns(bars(s, d)).select("symbol", "idx", "r"), "r", 1).drop("r")))
query("windows_close", f"WITH {WINDOWS_SQL} SELECT symbol, session::VARCHAR AS session, end_idx, end_ts::VARCHAR AS end_ts, valid, {num('fwd_ret', 'fwd_ret')}, {', '.join(num(f'v[{i + 1}]', f'x{i}') for i in range(W))} FROM w")(lambda s, d: shown(spread(all_windows(s, d), "x", W)))
query("norm_zscore", f"WITH {WINDOWS_SQL} SELECT symbol, session::VARCHAR AS session, end_idx, end_ts::VARCHAR AS end_ts, valid, {num('fwd_ret', 'fwd_ret')}, {', '.join(num(f'z[{i + 1}]', f'z{i}') for i in range(W))} FROM w")(lambda s, d: shown(spread(all_windows(s, d), "z", W)))
query("norm_raw", f"WITH {WINDOWS_SQL} SELECT symbol, session::VARCHAR AS session, end_idx, end_ts::VARCHAR AS end_ts, true AS valid, {num('fwd_ret', 'fwd_ret')}, {', '.join(num(f'v[{i + 1}]', f'z{i}') for i in range(W))} FROM w")(lambda s, d: shown(spread(all_windows(s, d, normalization="logret_raw"), "z", W)))
OHLC_SQL = f"""{BARS_SQL}, p AS (SELECT *, lag(close) OVER (PARTITION BY session ORDER BY idx) AS pc FROM x), q AS (
  SELECT symbol, idx AS end_idx, pos, {", ".join(f"list(ln({c} / pc)) OVER f AS {c}s" for c in B.PRICES)} FROM p WINDOW f AS (PARTITION BY session ORDER BY idx ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW))"""
query("windows_ohlc", f"WITH {OHLC_SQL} SELECT symbol, end_idx, {', '.join(num(f'{c}s[{i + 1}]', f'x{4 * i + j}') for i in range(W) for j, c in enumerate(B.PRICES))} FROM q WHERE pos >= {W}")(lambda s, d: shown(spread(all_windows(s, d, "ohlc").select("symbol", "end_idx", "x"), "x", 4 * W)))
query("forward_return", f"WITH {WINDOWS_SQL} SELECT symbol, idx, {num('fwd_ret', 'fwd_ret')} FROM ret")(lambda s, d: shown(windows.forward_return(bars(s, d), H).select("symbol", "idx", "fwd_ret")))
query("knn_eligible_stats", f"WITH {PAIRS_SQL} SELECT symbol, q_end, n_candidates, {num('uncond_mean', 'uncond_mean')} FROM uncond")(lambda s, d: shown(neighbours.unconditional(all_windows(s, d), W, H)))
query("knn_distance", f"WITH {PAIRS_SQL} SELECT symbol, q_end, count(*) AS n, {num('min(dist)', 'least')}, {num('max(dist)', 'most')}, {num('avg(dist)', 'mean')} FROM pairs GROUP BY 1, 2")(lambda s, d: shown(pairs_of(s, d)[1].groupBy("symbol", "q_end").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"), F.avg("dist").alias("mean"))))
NEAR_COLUMNS = f"symbol, q_end, end_idx, end_ts::VARCHAR AS end_ts, {num('fwd_ret', 'fwd_ret')}, {num('dist', 'dist')}, rank"
query("knn_topk", f"WITH {PAIRS_SQL} SELECT {NEAR_COLUMNS} FROM near")(lambda s, d: shown(neighbours.nearest(pairs_of(s, d)[1], K)))
query("knn_topk_blocks", f"WITH {PAIRS_SQL} SELECT {NEAR_COLUMNS} FROM near")(lambda s, d: shown(blocks_of(s, d)))
WIDE = (30, 15, 100, 15)  # the window, horizon, neighbours and gap of the settings' defaults, on 5-minute bars
query("knn_topk_wide", f"WITH {_pairs_sql(*WIDE, 5)} SELECT {NEAR_COLUMNS.replace("round(dist", "round(dist + 1e-10")} FROM near")(lambda s, d: shown(wide_of(s, d).withColumn("dist", F.col("dist") + 1e-10)))  # dist has nine decimals, so a 5 may stand where it is rounded
query("knn_dedup", f"WITH {PAIRS_SQL} SELECT symbol, q_end, kept_rank, rank, end_idx, end_ts::VARCHAR AS end_ts, {num('dist', 'dist')}, {num('fwd_ret', 'fwd_ret')} FROM kept")(lambda s, d: shown(kept_of(s, d)))
query("knn_match_stats", f"WITH {PAIRS_SQL} SELECT symbol, q_end, n, {num('mean', 'mean')}, {num('median', 'median')}, {num('pct_positive', 'pct_positive')} FROM stats")(lambda s, d: shown(neighbours.match_stats(kept_of(s, d))))
SIGNAL_COLUMNS = "symbol, session::VARCHAR AS session, idx, ts::VARCHAR AS ts, direction, reason"
query("knn_signals", f"WITH {KNN_SQL} SELECT {SIGNAL_COLUMNS}, q_end, n, {', '.join(num(c, c) for c in ('mean', 'median', 'pct_positive', 'uncond_mean', 'threshold'))}, n_candidates FROM knn")(lambda s, d: shown(signals.signals(bars(s, d), KNN)))
query("template_vectors", f"WITH {TEMPLATE_SQL} SELECT symbol, q_end, pattern, {', '.join(num(f't[{i + 1}]::DOUBLE', f't{i}') for i in range(W))} FROM tw JOIN tpl ON name = pattern")(
    lambda s, d: (lambda x: shown(spread(x.select("symbol", "q_end", "pattern").where("q_end is not null and pattern is not null").distinct().join(F.broadcast(signals.template_table(x, TEMPLATE)), F.col("pattern") == F.col("name")).select("symbol", "q_end", "pattern", "t"), "t", W).drop("t")))(signals.signals(bars(s, d), TEMPLATE))
)
query("template_distances", f"WITH {TEMPLATE_SQL} SELECT symbol, q_end, name, direction, ord::BIGINT AS ord, {num('dist', 'dist')} FROM td")(lambda s, d: shown(signals.template_distances(all_windows(s, d), signals.template_table(bars(s, d), TEMPLATE))))
query("template_signals", f"WITH {TEMPLATE_SQL} SELECT {SIGNAL_COLUMNS}, q_end, pattern, {num('distance', 'distance')}, n_matched, matched FROM template")(lambda s, d: shown(signals.signals(bars(s, d), TEMPLATE).withColumn("matched", F.array_join("matched", ","))))
query("candle_anatomy", f"WITH {BARS_SQL} SELECT symbol, idx, {num('abs(close - open)', 'body')}, {num('high - low', 'rng')}, {num('high - greatest(open, close)', 'upper')}, {num('least(open, close) - low', 'lower')}, close > open AS bullish, close < open AS bearish, {num('(open + close) / 2', 'mid')} FROM x")(
    lambda s, d: (lambda c: shown(bars(s, d).select("symbol", "idx", c.body.alias("body"), c.range.alias("rng"), c.upper.alias("upper"), c.lower.alias("lower"), c.bullish.alias("bullish"), c.bearish.alias("bearish"), c.middle.alias("mid"))))(candles.Candle(*(F.col(p) for p in B.PRICES)))
)
for _name in candles.CANDLES:
    query(f"candle_{_name}", f"WITH {LAGS_SQL} SELECT symbol, idx, ts::VARCHAR AS ts, {PRICE_SQL} FROM lags WHERE {FIRES_SQL[_name]}")(lambda s, d, name=_name: fired(s, d, name))
query("candle_signals", f"WITH {CANDLE_SQL} SELECT {SIGNAL_COLUMNS}, pattern, n_matched, matched FROM candle")(lambda s, d: shown(signals.signals(bars(s, d), CANDLE).withColumn("matched", F.array_join("matched", ","))))
query("fill_costs", f"WITH {BARS_SQL} SELECT symbol, idx, {num(f'lead(open) OVER s * (1 + {COST})', 'buy')}, {num(f'lead(open) OVER s * (1 - {COST})', 'sell')} FROM x WINDOW s AS (ORDER BY idx)")(
    lambda s, d: (lambda x: shown(x.select("symbol", "idx").join(x.select("symbol", (F.col("idx") - 1).alias("idx"), "open"), ["symbol", "idx"], "left").select("symbol", "idx", backtest.fill_price(F.col("open"), F.lit("buy"), KNN.cost_bps).alias("buy"), backtest.fill_price(F.col("open"), F.lit("sell"), KNN.cost_bps).alias("sell"))))(bars(s, d))
)
query("force_flat", f"WITH {BARS_SQL}, p AS (SELECT session, idx AS entry_idx, open AS entry_price FROM x WHERE bars_left > 0) SELECT 'EVT' AS symbol, entry_idx, l.idx AS exit_idx, {num('entry_price', 'entry_price')}, {num(f'l.close * (1 - {COST})', 'exit_price')}, {num(f'l.close * (1 - {COST}) / entry_price - 1', 'net_ret')}, 'force_flat' AS exit_reason FROM p JOIN x l ON l.session = p.session AND l.bars_left = 0")(lambda s, d: shown(backtest.forced_flat(bars(s, d), positions(s, d), KNN.cost_bps)))
for _name, _s, _base, _of in (("knn", KNN, KNN_SQL, "knn"), ("template", TEMPLATE, TEMPLATE_SQL, "template"), ("candles", CANDLE, CANDLE_SQL, "candle")):
    query(f"wf_asked_{_name}", f"WITH RECURSIVE {_walk_sql(_base, _of)} SELECT 'EVT' AS symbol, session::VARCHAR AS session, idx, direction FROM asked")(lambda s, d, c=_s: shown(walk(s, d, c)[1]))
    query(f"wf_trades_{_name}", f"WITH RECURSIVE {_walk_sql(_base, _of)} SELECT {TRADE_COLUMNS} FROM trades")(lambda s, d, c=_s: shown(walk(s, d, c)[2]))
    query(f"wf_metrics_{_name}", _summary_sql(_base, _of))(lambda s, d, c=_s: (lambda x, a, t: shown(backtest.summary(a, t, backtest.equity(t, x, c, CASH), CASH)))(*walk(s, d, c)))
WALK_SQL = _walk_sql(CANDLE_SQL, "candle")
query("wf_equity", f"WITH RECURSIVE {WALK_SQL} SELECT symbol, session::VARCHAR AS session, idx, ts::VARCHAR AS ts, {num('equity', 'equity')} FROM equity")(lambda s, d: (lambda x, a, t: shown(backtest.equity(t, x, CANDLE, CASH)))(*walk(s, d, CANDLE)))
query("sharpe", f"WITH {BARS_SQL}, y AS (SELECT session, close / lag(close) OVER (PARTITION BY session ORDER BY idx) - 1 AS r FROM x) SELECT session::VARCHAR AS session, {num(SHARPE_SQL.format('r', '252.0'), 'sharpe')} FROM y GROUP BY session")(lambda s, d: shown(windows.log_returns(bars(s, d)).withColumn("q", F.exp(F.col("r")[0]) - 1).groupBy("session").agg(metrics.sharpe("q", 252).alias("sharpe"))))
query("hit_rate", f"WITH {WINDOWS_SQL} SELECT session::VARCHAR AS session, {num('avg(CASE WHEN fwd_ret IS NOT NULL THEN (fwd_ret > 0)::INT END)', 'hit_rate')} FROM ret GROUP BY session")(lambda s, d: shown(windows.forward_return(bars(s, d), H).groupBy("session").agg(metrics.hit_rate("fwd_ret").alias("hit_rate"))))
query("max_drawdown", f"WITH {BARS_SQL} SELECT 'EVT' AS symbol, {num(_falls_sql('x', 'close'), 'max_drawdown')}")(lambda s, d: shown(metrics.max_drawdown(bars(s, d), "close", "idx", ["symbol"], "session")))
query("buy_and_hold", f"WITH {BARS_SQL}, dy AS (SELECT session, arg_max(close, idx) AS c FROM x GROUP BY 1), y AS (SELECT c / lag(c) OVER (ORDER BY session) - 1 AS r FROM dy) SELECT 'EVT' AS symbol, {num(f'(SELECT arg_max(close, idx) FROM x) * (1 - {COST}) / ((SELECT arg_min(open, idx) FROM x) * (1 + {COST})) - 1', 'total_return')}, {num(SHARPE_SQL.format('r', '252.0'), 'sharpe')}, {num(_falls_sql('x', 'close'), 'max_drawdown')} FROM y")(lambda s, d: shown(backtest.buy_and_hold(bars(s, d), KNN.cost_bps)))
RANDOM_SQL = f"""{WALK_SQL}, po AS (
  SELECT x.minute, x.idx, row_number() OVER (PARTITION BY x.minute ORDER BY x.idx) - 1 AS pick, count(*) OVER (PARTITION BY x.minute) AS size, o2 * (1 - {COST}) / (o1 * (1 + {COST})) - 1 AS ret
  FROM x JOIN ahead a ON a.idx = x.idx WHERE x.idx >= {KNN.min_history_bars} AND x.bars_left >= {H + 1}
), de AS (SELECT x.minute, row_number() OVER (ORDER BY t.idx) - 1 AS ord FROM taken t JOIN x ON x.idx = t.idx
), dr AS (
  SELECT r.resample, de.minute, ('0x' || substr(md5('{KNN.seed}|' || r.resample || '|' || de.ord), 1, 13))::BIGINT % z.size AS pick
  FROM de JOIN (SELECT DISTINCT minute, size FROM po) z ON z.minute = de.minute, (SELECT unnest(range({RESAMPLES})) AS resample) r
), rm AS (SELECT resample, avg(po.ret) AS mean_ret FROM dr JOIN po ON po.minute = dr.minute AND po.pick = dr.pick GROUP BY 1)"""


def random_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x, _, t = walk(spark, sf_dir, CANDLE)
    return backtest.random_means(x, t.select("symbol", F.col("signal_idx").alias("idx")), CANDLE, RESAMPLES), t


query("random_baseline", f"WITH RECURSIVE {RANDOM_SQL} SELECT 'EVT' AS symbol, resample::BIGINT AS resample, {num('mean_ret', 'mean_ret')} FROM rm")(lambda s, d: shown(random_of(s, d)[0]))
query("p_value", f"WITH RECURSIVE {RANDOM_SQL}, st AS (SELECT avg(net_ret) AS m FROM trades) SELECT 'EVT' AS symbol, {num('(1 + count(*) FILTER (round(mean_ret, 12) >= round(m, 12))) / (count(*) + 1)', 'p_value')}, count(*) AS n_resamples FROM rm, st HAVING count(*) > 0")(lambda s, d: (lambda m, t: shown(backtest.p_value(m, t.groupBy("symbol").agg(F.avg("net_ret").alias("mean_net_ret")))))(*random_of(s, d)))
query("alpha", f"WITH {RUNS_SQL} SELECT n AS n_configs, {num('alpha', 'alpha')} FROM tried")(lambda s, d: shown(ledger.configs_tried(runs(s, d))))
LEDGER_SQL = f"""WITH {RUNS_SQL}, g AS (
  SELECT config_hash, count(*) AS n_runs, max(started_at) AS last_run, arg_max(metrics_json, started_at) FILTER (status = 'ok') AS m FROM runs WHERE run_type = 'backtest' GROUP BY 1
), h AS (SELECT *, json_extract_string(m, '$.mean_net_ret')::DOUBLE AS mean_net_ret, json_extract_string(m, '$.p_random')::DOUBLE AS p_random FROM g)
SELECT config_hash, n_runs, last_run, {num("mean_net_ret", "mean_net_ret")}, {num("p_random", "p_random")}, {num("alpha", "alpha")}, coalesce(p_random < alpha AND mean_net_ret > 0, false) AS candidate FROM h, tried"""
query("ledger", LEDGER_SQL)(lambda s, d: shown(ledger.ledger(runs(s, d))))
DECIDE_SQL = """WITH c AS (SELECT event_id AS id, event_id % 9 AS n_trades, (user_id % 21 - 10)::DOUBLE AS mean, CASE WHEN event_id % 8 <> 0 THEN (event_id % 100) / 1000 END AS p, CASE WHEN event_id % 6 <> 0 THEN (event_id % 41 - 20)::DOUBLE END AS tm,
  CASE WHEN event_id % 10 <> 0 THEN (event_id % 5 - 2)::DOUBLE END AS ts1, (event_id % 3 - 1)::DOUBLE AS ts2 FROM events
), v AS (SELECT id, CASE WHEN n_trades = 0 THEN 'no_trades' ELSE concat_ws(',', CASE WHEN mean IS NULL OR mean <= 0 THEN 'mean_not_positive' END, CASE WHEN p IS NULL THEN 'no_p_value' WHEN p >= 0.05 THEN 'p_above_alpha' END,
  CASE WHEN tm > 0 AND mean < 0.25 * tm THEN 'inconsistent_with_train' END, CASE WHEN sign(ts1) <> sign(ts2) THEN 'sharpe_sign_flip' END) END AS reasons FROM c)
SELECT id, reasons, reasons = '' AS survived FROM v"""
query("verdict", DECIDE_SQL)(lambda s, d: ledger.decide(cases_of_decide(s, d)).select("id", F.array_join("reasons", ",").alias("reasons"), "survived"))
query("evaluation_verdicts", f"WITH {VERDICTS_SQL} SELECT evaluation_id, config_hash, verdict FROM vd")(lambda s, d: ledger.verdicts(evaluations(s, d)).select("evaluation_id", "config_hash", "verdict"))
query("survivor", f"WITH {VERDICTS_SQL} SELECT config_hash, bool_or(verdict = 'SURVIVED') AS armed FROM vd GROUP BY 1")(lambda s, d: (lambda v: ledger.armed(v.select("config_hash").distinct(), v))(ledger.verdicts(evaluations(s, d))))
query("banner", f"WITH {RUNS_SQL}, {VERDICTS_SQL}, c AS (SELECT count(*) AS t FROM vd) SELECT printf('%d configurations tried; corrected alpha %.6f; test set used %d %s', n, alpha, t, CASE WHEN t = 1 THEN 'TIME' ELSE 'TIMES' END) AS banner, n AS n_configs, t AS n_tests, {num('alpha', 'alpha')} FROM tried, c")(lambda s, d: shown(ledger.banner(runs(s, d), ledger.verdicts(evaluations(s, d)))))
query("append_new", f"WITH {SIGNALS_SQL} SELECT id, config_hash, signal_ts, CASE WHEN id % 3 = 0 THEN 'old' ELSE status END AS status FROM js")(lambda s, d: (lambda j: journal.append_new(j.where("id % 3 = 0").withColumn("status", F.lit("old")), j, ["id", "config_hash", "signal_ts"]))(journal_signals(s, d)))
query("current_orders", f"WITH {ORDERS_SQL} SELECT signal_id, arg_max(status, submitted_at) AS status, arg_max(symbol, submitted_at) AS symbol FROM jo GROUP BY 1")(lambda s, d: ledger.current(journal_orders(s, d).select("signal_id", F.col("submitted_at").alias("seq"), "status", "symbol"), "signal_id").select("signal_id", "status", "symbol"))
query("sync_signals", f"WITH {ORDERS_SQL}, {SIGNALS_SQL} SELECT id, config_hash, signal_ts, coalesce((SELECT arg_max(status, submitted_at) FROM jo WHERE signal_id = id), status) AS status FROM js")(lambda s, d: journal.sync_signals(journal_signals(s, d), journal_orders(s, d)))
query("open_entry", f"WITH {ORDERS_SQL}, {SIGNALS_SQL} SELECT config_hash, symbol, arg_max(signal_ts, submitted_at) AS signal_ts FROM jo JOIN js ON js.id = jo.signal_id WHERE intent = 'entry' GROUP BY 1, 2")(lambda s, d: journal.open_entry(journal_orders(s, d), journal_signals(s, d)))
query("paired_trades", f"WITH {ORDERS_SQL} SELECT symbol, entry_ts::VARCHAR AS entry_ts, exit_ts::VARCHAR AS exit_ts, qty, {', '.join(num(c, c) for c in ('entry_price', 'exit_price', 'net_ret', 'pnl'))}, exit_reason FROM tr")(lambda s, d: shown(journal.paired_trades(journal_orders(s, d))))
query("weekly_metrics", f"WITH {ORDERS_SQL} SELECT symbol, count(*) AS n_trades, {num('avg((net_ret > 0)::INT)', 'hit_rate')}, {num('avg(net_ret)', 'mean_net_ret')}, {num('sum(pnl)', 'total_pnl')} FROM tr WHERE exit_ts <= TIMESTAMP '{CUT}' AND exit_ts >= TIMESTAMP '{CUT}' - INTERVAL 7 DAY GROUP BY 1")(lambda s, d: shown(journal.weekly(journal.paired_trades(journal_orders(s, d)), F.lit(CUT).cast("timestamp_ntz"))))
query("equity_vs_benchmark", f"WITH {BARS_SQL}, {SNAPSHOTS_SQL} SELECT 'EVT' AS symbol, {num('any_value(e0)', 'equity_start')}, {num('any_value(e1)', 'equity_end')}, {num('arg_max(close, ts) / arg_min(close, ts) - 1', 'bh_return')} FROM x, sp WHERE ts BETWEEN t0 AND t1")(lambda s, d: shown(journal.against_benchmark(snapshots(s, d), bars(s, d))))
query("benchmark_rebased", f"WITH {BARS_SQL}, {SNAPSHOTS_SQL} SELECT 'EVT' AS symbol, ts::VARCHAR AS ts, {num('close / first_value(close) OVER (ORDER BY ts) * e0', 'benchmark')} FROM x, sp WHERE ts BETWEEN t0 AND t1")(lambda s, d: shown(journal.rebased(snapshots(s, d), bars(s, d))))
query("bars_since_entry", f"WITH {BARS_SQL} SELECT 'EVT' AS symbol, count(*) FILTER (ts > TIMESTAMP '{CUT}') AS n FROM x")(lambda s, d: journal.bars_since(bars(s, d), bars(s, d).groupBy("symbol").agg(F.lit(CUT).cast("timestamp_ntz").alias("entry_ts"))))
query("status_counts", f"WITH {ORDERS_SQL} SELECT symbol, count(*) FILTER (status = 'filled') AS n_filled, count(*) FILTER (status = 'filled' AND intent IN ('time_stop', 'force_flat')) AS n_closed, count(*) FILTER (status = 'open') AS n_open FROM jo GROUP BY 1")(lambda s, d: journal.status(journal_orders(s, d)))
query("live_step_cases", f"WITH {STEP_SQL} SELECT id, outcome, {num('CASE WHEN outcome = ' + repr('entry') + ' THEN q WHEN starts_with(outcome, ' + repr('exit:') + ') THEN held END', 'qty')} FROM ou")(lambda s, d: journal.step(step_cases(s, d), H, 5, 0.05).select("id", "outcome", (F.round(F.col("qty").cast("double"), 6) + 0.0).alias("qty")))
query("order_states", "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'filled' WHEN 1 THEN 'open' WHEN 2 THEN 'rejected' WHEN 3 THEN 'rejected' ELSE 'open' END AS state FROM events")(lambda s, d: table(s, d, "events").select(F.col("event_id").alias("id"), journal.order_state(F.element_at(F.array(*(F.lit(x) for x in ("FILLED", "partially_filled", "canceled", "expired", "accepted"))), (F.col("event_id") % 5 + 1).cast("int"))).alias("state")))
OVERLAY_SQL = f"{PAIRS_SQL}, m AS (SELECT DISTINCT end_idx FROM kept), o AS (SELECT end_idx, unnest(range({-W}, {H + 1})) AS step FROM m), p AS (SELECT o.end_idx, step, close FROM o JOIN x ON x.idx = o.end_idx + step)"
query("overlay_rebase", f"WITH {OVERLAY_SQL} SELECT 'EVT' AS symbol, end_idx, step::BIGINT AS step, {num(f'close / first_value(close) OVER (PARTITION BY end_idx ORDER BY step)', 'level')} FROM p WHERE end_idx >= {W}")(lambda s, d: shown(journal.overlay(bars(s, d), kept_of(s, d).select("symbol", "end_idx").distinct(), W, H)))
HISTOGRAM_SQL = f"{WINDOWS_SQL}, hs AS (SELECT count(*) AS c, min(fwd_ret) AS a, max(fwd_ret) AS b, least(30, greatest(5, count(*) // 2)) AS k FROM w WHERE fwd_ret IS NOT NULL), hb AS (SELECT least(k - 1, floor((fwd_ret - a) / ((b - a) / k)))::BIGINT AS bin, a, (b - a) / k AS wd FROM w, hs WHERE fwd_ret IS NOT NULL)"
query("fwd_histogram", f"WITH {HISTOGRAM_SQL} SELECT bin, {num('any_value(a) + bin * any_value(wd)', 'lo')}, {num('any_value(a) + (bin + 1) * any_value(wd)', 'hi')}, count(*) AS n FROM hb GROUP BY bin")(lambda s, d: shown(journal.histogram(all_windows(s, d), "fwd_ret")))
IDENTITIES = {c.signal_source: c.identity_json() for c in (KNN, TEMPLATE, CANDLE)}  # of the symbol EVT


@query("config_hash", "SELECT source, event_type AS symbol, substr(sha256(replace(identity, '\"EVT\"', '\"' || event_type || '\"')), 1, 12) AS config_hash FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in IDENTITIES.items()) + ") AS t(source, identity), (SELECT DISTINCT event_type FROM events)")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each of the three configurations for each symbol that the ticks may be taken to have."""
    symbols = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    named = [F.struct(F.lit(k).alias("source"), F.replace(F.lit(v), F.lit('"EVT"'), F.concat(F.lit('"'), "symbol", F.lit('"'))).alias("identity")) for k, v in IDENTITIES.items()]
    return symbols.select("symbol", F.inline(F.array(*named))).select("source", "symbol", F.substring(F.sha2("identity", 256), 1, 12).alias("config_hash"))


@query("stream_closed_bars", f"WITH {BARS_SQL} SELECT symbol, ts::VARCHAR AS ts, {PRICE_SQL}, volume FROM b WHERE ts < (SELECT time_bucket(INTERVAL '{MINUTES} minutes', max(ts)) FROM events WHERE value > 0)")
def stream_closed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that a stream over events has closed; the last one stays open for want of a later tick."""
    events = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(events).schema
    ticks = spark.readStream.schema(schema).parquet(f"{events}*")
    return shown(live.written(live.closed_bars(ticks, MINUTES), f"{folders.shared_dir(spark)}/closed-bars-{uuid.uuid4().hex}"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql is not None}
