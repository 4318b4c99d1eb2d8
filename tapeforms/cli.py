"""The command line: python -m tapeforms.cli COMMAND. Bars, studies and the journal are kept below the setting `warehouse`; `db_path` names a folder of database shards, or a file
in one, that bars come from."""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeforms.operators import bars as B
from tapeforms.operators import journal, ledger, simulator
from tapeforms.plans import research
from tapeforms.plans.settings import Settings, from_yaml, settings
from tapeforms.sources import shards
from tapeforms.sources.store import BarStore
from tapeforms.streaming import shapes
from tapeforms.streaming import signals as S


class Refused(RuntimeError):
    """What a command says when it can't go on."""


class Desk:
    """Where the commands find their bars and logs."""

    def __init__(self, spark: SparkSession, s: Settings):
        self.spark, self.s, self.symbol = spark, s, s.symbols[0]
        self.store = BarStore(spark, f"{s.warehouse}/bars")
        self.minutes = int(s.timeframe.removesuffix("Min"))
        self.journal_path = f"{s.warehouse}/journal-{s.hash}"

    def shards(self) -> str:
        if not self.s.db_path:
            raise Refused("set db_path to the folder of the shards")
        path = os.path.dirname(self.s.db_path) or "." if self.s.db_path.endswith(".db") else self.s.db_path
        return path if "://" in path else f"file://{os.path.abspath(path)}"

    def bars(self, symbol: str | None = None) -> DataFrame:
        rows = self.store.read().where(F.col("symbol") == (symbol or self.symbol))
        if rows.isEmpty():
            raise Refused(f"no bars of {symbol or self.symbol}: run data refresh")
        return rows.select("symbol", "ts", *B.PRICES, "volume")

    def study(self, bars: DataFrame | None = None) -> research.Study:
        return research.Study(self.spark, f"{self.s.warehouse}/study", self.bars() if bars is None else bars)

    def logs(self) -> research.Study:
        """The study for its logs alone."""
        return self.study(self.store.read())

    def journal(self) -> DataFrame:
        """The decisions of this configuration, one per bar."""
        if not self.store._exists(self.journal_path):
            return self.spark.createDataFrame([], simulator.REPLAY)
        return self.spark.read.schema(simulator.REPLAY).parquet(self.journal_path).where(S.is_bar())


def percent(x: float | None) -> str:
    return "-" if x is None else f"{x:+.4%}"


def refresh(d: Desk, a: argparse.Namespace) -> list[str]:
    feed = shards.read(d.spark, d.shards()).where(F.col("symbol").isin(*d.s.symbols))
    return [f"{d.store.refresh(feed)} bars taken over", *coverage(d, a)]


def coverage(d: Desk, a: argparse.Namespace) -> list[str]:
    known = {r["symbol"]: r for r in d.store.coverage().where(F.col("symbol").isin(*d.s.symbols)).collect()}  # the settings name few
    return [f"{n}: {known[n]['n_bars']:,} bars in {known[n]['n_sessions']:,} sessions, {known[n]['first_session']} to {known[n]['last_session']}, {known[n]['n_short']} short" if n in known else f"{n}: no bars: run data refresh" for n in d.s.symbols]


def match(d: Desk, a: argparse.Namespace) -> list[str]:
    at = dt.datetime.fromisoformat(a.asof)
    utc = (at if at.tzinfo else at.replace(tzinfo=ZoneInfo("America/New_York"))).astimezone(dt.UTC)
    found = research.match(d.bars(a.symbol.upper() or None), d.s, f"{utc:%Y-%m-%d %H:%M:%S}")
    row = found.figures.first()
    if row is None:
        raise Refused(f"no window ends at {utc:%Y-%m-%d %H:%M} UTC")
    out = [d.logs().banner(), f"{row['symbol']} at {utc:%Y-%m-%d %H:%M} UTC: {row['n_candidates']:,} candidates, {row['n']} kept"]
    if not row["n"]:
        return [*out, "no matches: too little history before that time"]
    kept = found.head().collect()
    return [*out, *(f"{r['kept_rank']:3d}  bar {r['end_idx']}  distance {r['dist']:.3f}  return {percent(r['fwd_ret'])}" for r in kept)]


def shown(figures: dict) -> list[str]:
    return [f"{name}: {percent(x) if name in ('mean_net_ret', 'hit_rate', 'total_return', 'max_drawdown') else x}" for name, x in figures.items()]


def backtest(d: Desk, a: argparse.Namespace) -> list[str]:
    study = d.study()
    return [f"configuration {d.s.hash}, up to {d.s.split_date}", *shown(study.backtest(d.s, a.resamples)), study.banner()]


def evaluate(d: Desk, a: argparse.Namespace) -> list[str]:
    study = d.study()
    if not a.yes and input(f"This spends an evaluation of {a.config_hash} for good. Type the hash to go on: ").strip() != a.config_hash:
        raise Refused("not the hash; nothing is spent")
    try:
        survived, reasons, figures = study.evaluate(a.config_hash, a.resamples)
    except (KeyError, ValueError, research.AlreadyClaimed) as e:
        raise Refused(str(e)) from e
    return ["SURVIVED" if survived else "REJECTED", *(f"- {r}" for r in reasons), *shown(figures), study.banner()]


def tried(d: Desk, a: argparse.Namespace) -> list[str]:
    study = d.logs()
    rows = study.ledger().orderBy("config_hash").toLocalIterator()
    return [study.banner(), *(f"{r['config_hash']}  runs {r['n_runs']}  mean {percent(r['mean_net_ret'])}  p {r['p_random']}  {'candidate' if r['candidate'] else ''}".rstrip() for r in rows)]


def trade(d: Desk, a: argparse.Namespace) -> list[str]:
    """Decides on the bars of the shards as they come; until it is stopped with --follow, else on what is there. A bar that is corrected later is not decided again."""
    stream = shards.stream(d.spark, d.shards(), d.symbol).withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 day").dropDuplicatesWithinWatermark(["symbol", "ts"]).drop("t")
    trigger = {"processingTime": f"{a.poll} seconds"} if a.follow else {"availableNow": True}
    poll = a.poll if a.follow else None
    queries = []
    try:
        if d.s.signal_source == "knn_shape":
            S.require_survivor(d.logs().verdicts(), d.s)
            folder = f"{d.s.warehouse}/signals-{d.s.hash}"
            queries.append(shapes.start(stream, d.s, folder, **trigger))
            if not a.follow:
                queries[0].awaitTermination()
            rows = shapes.decided(d.spark, folder, d.s, d.minutes, poll=poll)
        else:
            rows = S.traded(stream, d.s, d.minutes, d.logs().verdicts(), poll=poll)
    except (S.NotASurvivor, ValueError) as e:
        raise Refused(str(e)) from e
    with S.rocks(d.spark):
        queries.append(rows.writeStream.outputMode("append").format("parquet").option("path", d.journal_path).option("checkpointLocation", f"{d.s.warehouse}/checkpoint-{d.s.hash}").trigger(**trigger).start())
    try:
        while all(q.isActive for q in queries):
            queries[-1].awaitTermination(1)
    finally:
        for q in queries:
            if a.follow:
                q.stop()
    for q in queries:
        q.awaitTermination()  # raises what ended it
    return status(d, a)


def status(d: Desk, a: argparse.Namespace) -> list[str]:
    rows = d.journal()
    armed = ledger.armed(d.spark.createDataFrame([(d.s.hash,)], "config_hash string"), d.logs().verdicts()).select(F.lit(d.symbol).alias("symbol"), "armed")
    found = journal.full_status(simulator.orders_of(rows), simulator.snapshots(rows), armed).where(F.col("symbol") == d.symbol).first()
    if found is None:
        return [f"{d.symbol}: nothing traded yet"]
    return [f"{d.symbol} at {found['last_snapshot']}: {'armed' if found['armed'] else 'not armed'}, holds {found['qty']:g}, equity {found['equity']:,.2f}; orders filled {found['n_filled']}, closed {found['n_closed']}, open {found['n_open']}"]


def weekly(d: Desk, a: argparse.Namespace) -> list[str]:
    rows = d.journal().where(F.col("symbol") == d.symbol)
    last = rows.agg(F.max("ts")).first()[0]
    if last is None:
        raise Refused("nothing traded yet")
    end = F.lit(last).cast("timestamp_ntz")
    since = F.col("ts") >= end - F.expr(f"interval {int(a.days)} days")
    shots = simulator.snapshots(rows).where(since).select("symbol", "ts", F.col("account_equity").alias("equity"))
    known = d.logs().ledger().where(F.col("config_hash") == d.s.hash).first()
    text = journal.weekly_report(journal.weekly(journal.paired_trades(simulator.orders_of(rows)), end, int(a.days)), journal.against_benchmark(shots, d.bars()), known["mean_net_ret"] if known else None)
    os.makedirs(d.s.reports_dir, exist_ok=True)
    path = f"{d.s.reports_dir}/weekly-{last:%Y-%m-%d}.md"
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return [text, f"written to {path}"]


def config(d: Desk, a: argparse.Namespace) -> list[str]:
    return [*(f"{k}: {v}" for k, v in d.s.identity().items()), f"config_hash: {d.s.hash}"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tapeforms")
    top.add_argument("--config", default="config.yaml", help="a file of settings; defaults if there is none")
    commands = top.add_subparsers(required=True)

    def command(of, name: str, run, **options) -> argparse.ArgumentParser:
        p = of.add_parser(name, help=(run.__doc__ or "").split(".")[0] or None)
        p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        for flag, default in options.items():
            p.add_argument(f"--{flag}", **({"action": "store_true"} if default is False else {"required": True} if default is None else {"type": type(default), "default": default}))
        p.set_defaults(run=run)
        return p

    data = commands.add_parser("data").add_subparsers(required=True)
    command(data, "refresh", refresh)
    command(data, "status", coverage)
    command(commands, "match", match, asof=None, symbol="")
    command(commands, "backtest", backtest, resamples=1000)
    command(commands, "evaluate", evaluate, resamples=1000, yes=False).add_argument("config_hash")
    command(commands, "ledger", tried)
    command(commands, "trade", trade, poll=60.0, follow=False)
    command(commands, "status", status)
    command(commands.add_parser("report").add_subparsers(required=True), "weekly", weekly, days=7)
    command(commands, "config", config)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        s = from_yaml(a.config, a.set) if os.path.exists(a.config) else settings({}, a.set)
        session = spark or SparkSession.builder.appName("tapeforms").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        print("\n".join(a.run(Desk(session, s), a)))
    except (Refused, KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
