"""A study from end to end: match a shape, backtest a configuration on the training part, evaluate it once on the rest.

The logs below a folder are all that is kept. A run and an evaluation are written down before anything is computed, so
one that crashes counts.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeforms.operators import backtest, ledger, neighbours, signals, windows
from tapeforms.operators import bars as B
from tapeforms.plans.settings import Settings, settings
from tapeforms.sources import folders
from tapeforms.sources.store import Claims, EventLog

FIGURES = ("n_trades", "mean_net_ret", "hit_rate", "sharpe", "total_return", "max_drawdown")


class AlreadyClaimed(RuntimeError):
    """Another evaluator is spending, or has spent, this evaluation."""


@dataclass
class Match:
    """The figures of the window current at a time (a row per symbol), and its kept neighbours, best first."""

    figures: DataFrame
    kept: DataFrame

    def head(self, n: int = 10) -> DataFrame:
        """The best n neighbours of each symbol's window, to be shown."""
        return self.kept.where(F.col("kept_rank") <= n).orderBy("symbol", "kept_rank")


def match(bars: DataFrame, s: Settings, asof: str) -> Match:
    """What followed the k most similar windows before the one that is current at asof (UTC). Only that window is compared."""
    w = windows.windows(B.indexed(bars), s.window, s.horizon, s.features, s.normalization)
    own = windows.window_at(w, F.lit(asof).cast("timestamp_ntz")).where("valid").select("symbol", F.col("end_idx").alias("q_end"), F.col("z").alias("qz"))
    width = s.window * (1 if s.features == "close" else 4)
    pairs = neighbours.distances(w, own, s.window, s.horizon, width)
    kept = folders.cut(neighbours.without_overlaps(neighbours.nearest(pairs, s.k), s.k, s.dedup_gap))
    candidates = own.join(w.where("valid and fwd_ret is not null"), "symbol").where(neighbours.eligible(s.window, s.horizon)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_candidates"))
    figures = own.select("symbol", "q_end").join(candidates, "symbol", "left").join(neighbours.match_stats(kept), ["symbol", "q_end"], "left").fillna(0, ["n_candidates", "n"])
    return Match(figures, kept)


class Study:
    """Backtests and evaluations of configurations over the same bars, with the logs that the corrected threshold counts on."""

    RUNS = "id long, seq long, run_type string, config_hash string, started_at timestamp, finished_at timestamp, status string, metrics_json string"
    CONFIGS = "config_hash string, identity string"
    EVALUATIONS = "evaluation_id long, config_hash string, seq long, verdict string, metrics_json string"
    TRADES = "run_id long, symbol string, side string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double, exit_price double, gross_return double, net_return double"

    def __init__(self, spark: SparkSession, folder: str, bars: DataFrame):
        self.spark, self.bars = spark, bars
        self.runs, self.configs, self.evaluations, self.trades = (EventLog(spark, f"{folder}/{n}", schema) for n, schema in (("runs", self.RUNS), ("configs", self.CONFIGS), ("evaluations", self.EVALUATIONS), ("trades", self.TRADES)))
        self.claims = Claims(spark, f"{folder}/claims")

    def ledger(self) -> DataFrame:
        return ledger.ledger(ledger.current(self.runs.read(), "id"))

    def verdicts(self) -> DataFrame:
        """A row per evaluation that was spent. One that was claimed and then never written down, for its evaluator was killed in between, is CRASHED with an id below 0."""
        known = ledger.verdicts(self.evaluations.read()).select("evaluation_id", "config_hash", "verdict")
        claims = self.spark.createDataFrame([(name.rsplit("-", 1)[0],) for name in self.claims.taken()], "config_hash string").groupBy("config_hash").agg(F.count(F.lit(1)).alias("_claims"))
        written = known.groupBy("config_hash").agg(F.count(F.lit(1)).alias("_n"))
        lost = claims.join(written, "config_hash", "left").where(F.col("_claims") > F.coalesce("_n", F.lit(0)))
        numbers = F.explode(F.sequence(F.coalesce("_n", F.lit(0)) + 1, F.col("_claims")))
        return known.unionByName(lost.select("config_hash", numbers.alias("_k")).select((-F.col("_k")).cast("long").alias("evaluation_id"), "config_hash", F.lit("CRASHED").alias("verdict")))

    def spent(self, config_hash: str) -> int:
        """How many evaluations of the configuration were claimed."""
        return sum(name.rsplit("-", 1)[0] == config_hash for name in self.claims.taken())

    def banner(self) -> str:
        return ledger.banner(self.runs.read(), self.verdicts()).first()["banner"]

    def _now(self) -> int:
        return time.time_ns()

    def _begun(self, run_type: str, s: Settings) -> int:
        run = self._now()
        if self.configs.read().where(F.col("config_hash") == s.hash).isEmpty():
            self.configs.append([(s.hash, s.identity_json())])
        row = self.spark.createDataFrame([(run, run, run_type, s.hash, "running")], "id long, seq long, run_type string, config_hash string, status string")
        self.runs.append(row.select("id", "seq", "run_type", "config_hash", F.current_timestamp().alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), "status", F.lit(None).cast("string").alias("metrics_json")))
        return run

    def _ended(self, run: int, status: str, metrics: dict[str, Any] | None = None) -> None:
        row = self.spark.createDataFrame([(run, self._now(), status, json.dumps(metrics) if metrics is not None else None)], "id long, seq long, status string, metrics_json string")
        none = F.lit(None)
        self.runs.append(row.select("id", "seq", none.cast("string").alias("run_type"), none.cast("string").alias("config_hash"), none.cast("timestamp").alias("started_at"), F.current_timestamp().alias("finished_at"), "status", "metrics_json"))

    def _walked(self, s: Settings, bars: DataFrame, run: int, resamples: int, from_test: bool) -> dict[str, Any]:
        """The figures of a walk-forward and its p-value; its trades go to the log."""
        x = folders.cut(B.indexed(bars))
        first = 0
        if from_test:
            row = B.first_test_idx(x, s.split_date).first()
            if row is None or row["first_test_idx"] is None:
                raise ValueError(f"no bars after {s.split_date}")
            first = row["first_test_idx"]
        asked = folders.cut(backtest.asked(signals.signals(x, s), x, s, first))
        trades = folders.cut(backtest.trades(asked, x, s))
        row = backtest.summary(asked, trades, backtest.equity(trades, x, s)).first()
        out = {name: row[name] for name in FIGURES}
        if out["n_trades"]:
            means = backtest.random_means(x, trades.select("symbol", F.col("signal_idx").alias("idx")), s, resamples, first)
            own = trades.groupBy("symbol").agg(F.avg("net_ret").alias("mean_net_ret"))
            out["p_random"] = backtest.p_value(means, own).first()["p_value"]
        self.trades.append(backtest.saved_trades(trades, x, run))
        return out

    def backtest(self, s: Settings, resamples: int = 1000) -> dict[str, Any]:
        """A walk-forward over the sessions up to the split, in the ledger whatever becomes of it."""
        run = self._begun("backtest", s)
        try:
            metrics = self._walked(s, self._of(s, B.before_split(self.bars, s.split_date)), run, resamples, False)
        except BaseException:
            self._ended(run, "crashed")
            raise
        self._ended(run, "ok", metrics)
        return metrics

    def evaluate(self, config_hash: str, resamples: int = 1000, number: int | None = None, **unhashed: Any) -> tuple[bool, list[str], dict[str, Any]]:
        """The one evaluation of a configuration on what is after the split: (survived, reasons, figures). It is spent before it is computed.

        Which evaluation it is, from 0, is `number`, by default the next. Of several evaluators that ask for the same one, the first to claim it goes on, and
        the others get AlreadyClaimed.
        `unhashed` are settings that are not part of the identity, such as the seed.
        """
        stored = self.configs.read().where(F.col("config_hash") == config_hash).first()
        if stored is None:
            raise KeyError(f"unknown configuration {config_hash!r}: backtest it first")
        s = settings(json.loads(stored["identity"]) | unhashed)
        if s.hash != config_hash:
            raise ValueError("what is stored does not give this hash")
        done = ledger.current(self.runs.read(), "id").where((F.col("config_hash") == config_hash) & (F.col("run_type") == "backtest") & (F.col("status") == "ok"))
        train = done.orderBy(F.desc("started_at"), F.desc("id")).first()
        if train is None:
            raise ValueError("no finished backtest of this configuration")
        number = self.spent(config_hash) if number is None else number
        if not self.claims.take(f"{config_hash}-{number}"):
            raise AlreadyClaimed(f"evaluation {number} of {config_hash}")
        run = self._begun("evaluate", s)
        self.evaluations.append([(run, config_hash, self._now(), None, None)])
        try:
            test = self._walked(s, self._of(s, self.bars), run, resamples, True)
        except BaseException:
            self._ended(run, "crashed")
            raise
        before = json.loads(train["metrics_json"])
        alpha = ledger.configs_tried(ledger.current(self.runs.read(), "id")).first()["alpha"]
        case = [(test["n_trades"], test["mean_net_ret"], test.get("p_random"), alpha, before["mean_net_ret"], before["sharpe"], test["sharpe"])]
        row = ledger.decide(self.spark.createDataFrame(case, "n_trades long, mean double, p double, alpha double, train_mean double, train_sharpe double, test_sharpe double")).first()
        self.evaluations.append([(run, config_hash, self._now(), "SURVIVED" if row["survived"] else "REJECTED", json.dumps(test))])
        self._ended(run, "ok", test)
        return row["survived"], row["reasons"], test

    def _of(self, s: Settings, bars: DataFrame) -> DataFrame:
        return bars.where(F.col("symbol") == s.symbols[0])
