"""The multiple-testing ledger: append-only events, the corrected threshold, the verdict, and the gate that it arms.

Parquet has no update, so runs and evaluations are logs of events with a rising seq, and what holds is each id's latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_ALPHA = 0.05
CONSISTENT = 0.25


def alpha(n: Column) -> Column:
    """The Bonferroni threshold after n configurations."""
    return BASE_ALPHA / F.greatest(n, F.lit(1))


def current(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The latest row per key; a later event that leaves a column null keeps the earlier value."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in log.columns if c not in (key, seq)]
    return log.groupBy(key).agg(*latest)


def configs_tried(runs: DataFrame) -> DataFrame:
    """(n_configs, alpha): configurations with any backtest, crashed ones too."""
    n = F.count_distinct(F.when(F.col("run_type") == "backtest", F.col("config_hash")))
    return runs.agg(n.alias("n_configs"), alpha(n).alias("alpha"))


def is_candidate(p: Column, mean: Column, threshold: Column) -> Column:
    return F.coalesce((p < threshold) & (mean > 0), F.lit(False))


def ledger(runs: DataFrame) -> DataFrame:
    """Per configuration: its backtests, the last one's start, the figures of the last that ended well, and whether it is a candidate."""
    tests = runs.where("run_type = 'backtest'")
    figures = F.max_by("metrics_json", F.when((F.col("status") == "ok") & F.col("metrics_json").isNotNull(), F.struct("started_at", "id")))
    rows = tests.groupBy("config_hash").agg(F.count(F.lit(1)).alias("n_runs"), F.max("started_at").alias("last_run"), figures.alias("_m"))
    rows = rows.crossJoin(F.broadcast(configs_tried(runs)))

    def read(name: str) -> Column:
        value = F.get_json_object("_m", f"$.{name}").try_cast("double")
        return F.when(~F.isnan(value), value)

    out = rows.withColumns({"mean_net_ret": read("mean_net_ret"), "p_random": read("p_random")})
    return out.withColumn("candidate", is_candidate(F.col("p_random"), F.col("mean_net_ret"), F.col("alpha"))).drop("_m", "n_configs")


def decide(cases: DataFrame) -> DataFrame:
    """cases (n_trades, mean, p, alpha, train_mean, train_sharpe, test_sharpe and more) with reasons and survived.

    Every failure is listed, but without trades nothing else is looked at. Missing figures are null.
    """
    mean, p, a = F.col("mean"), F.col("p"), F.col("alpha")
    checks = [
        F.when(F.coalesce(mean <= 0, F.lit(True)), F.lit("mean_not_positive")),
        F.when(p.isNull(), F.lit("no_p_value")).when(p >= a, F.lit("p_above_alpha")),
        F.when((F.col("train_mean") > 0) & (mean < CONSISTENT * F.col("train_mean")), F.lit("inconsistent_with_train")),
        F.when(F.signum("train_sharpe") != F.signum("test_sharpe"), F.lit("sharpe_sign_flip")),
    ]
    reasons = F.when(F.col("n_trades") == 0, F.array(F.lit("no_trades"))).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))
    return cases.withColumn("reasons", reasons).withColumn("survived", F.size("reasons") == 0)


def verdicts(events: DataFrame) -> DataFrame:
    """(evaluation_id, config_hash, verdict) from events (evaluation_id, config_hash, seq, verdict): spent and never finished is CRASHED."""
    return current(events, "evaluation_id").withColumn("verdict", F.coalesce("verdict", F.lit("CRASHED")))


def survivors(verdicts_: DataFrame) -> DataFrame:
    return verdicts_.where("verdict = 'SURVIVED'").select("config_hash").distinct()


def armed(configs: DataFrame, verdicts_: DataFrame) -> DataFrame:
    """configs with whether any evaluation of them survived."""
    return configs.join(survivors(verdicts_).withColumn("armed", F.lit(True)), "config_hash", "left").fillna(False, ["armed"])


def banner(runs: DataFrame, verdicts_: DataFrame) -> DataFrame:
    """One line on how often this was tried."""
    counts = configs_tried(runs).crossJoin(verdicts_.agg(F.count(F.lit(1)).alias("n_tests")))
    times = F.when(F.col("n_tests") == 1, "TIME").otherwise("TIMES")
    return counts.select(F.format_string("%d configurations tried; corrected alpha %.6f; test set used %d %s", "n_configs", "alpha", "n_tests", times).alias("banner"), "n_configs", "n_tests", "alpha")
