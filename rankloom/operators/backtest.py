"""Portfolio simulation of scores and its statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.registry import register

YEAR = 252


@dataclass
class BacktestResult:
    nav: DataFrame
    stats: DataFrame
    positions: DataFrame | None = None


def forward_sums(returns: DataFrame, h: int, column: str = "log_ret") -> DataFrame:
    """(date, security_id, fwd): sum of the security's next h records; NULL until all are there."""
    w = W.partitionBy("security_id").orderBy("date").rowsBetween(1, h)
    return returns.select("date", "security_id", F.when(F.count(column).over(w) == h, F.sum(column).over(w)).alias("fwd"))


def every(df: DataFrame, step: int) -> DataFrame:
    """Rows on every step-th of the table's days, from its first."""
    days = df.select("date").distinct().select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("_at")).where(F.col("_at") % step == 0)
    return df.join(F.broadcast(days.select("date")), "date", "left_semi")


def tails(df: DataFrame, top_k: int) -> DataFrame:
    """Adds side +1 / -1 for the top_k highest and lowest scores of days with at least 2 * top_k names; other rows are left out."""
    day = W.partitionBy("date")
    r = df.withColumns({"_n": F.count(F.lit(1)).over(day), "_lo": F.row_number().over(day.orderBy("score", "security_id"))})
    side = F.when(F.col("_lo") > F.col("_n") - top_k, 1).when(F.col("_lo") <= top_k, -1)
    return r.where(F.col("_n") >= 2 * top_k).withColumn("side", side).where("side is not null").drop("_n", "_lo")


def long_short_periods(scores: DataFrame, returns: DataFrame, top_k: int = 40, freq: int = 5, cost_bps: float = 10.0) -> DataFrame:
    """(date, gross, net): half the difference of the tails' mean forward return, every freq-th day."""
    j = scores.join(forward_sums(returns, freq), ["date", "security_id"]).where("fwd is not null and score is not null")
    t = tails(every(j, freq), top_k)
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("fwd")))
    per = t.groupBy("date").agg((F.lit(0.5) * (mean(1) - mean(-1))).alias("gross"))
    return per.select("date", "gross", (F.col("gross") - F.lit(cost_bps / 1e4)).alias("net"))


def curve(periods: DataFrame, freq: int = 5, window: int = 24) -> DataFrame:
    """(date, net, equity, drawdown, rolling_sharpe) over the rebalance days, which are few: one ordered pass."""
    w = W.orderBy("date")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    e = periods.withColumn("equity", F.product(F.col("net") + 1).over(upto))
    last = w.rowsBetween(-(window - 1), 0)
    sharpe = F.when(F.count("net").over(last) == window, F.try_divide(F.avg("net").over(last), F.stddev_samp("net").over(last)) * F.lit((YEAR / freq) ** 0.5))
    return e.select("date", "net", "equity", (F.col("equity") / F.max("equity").over(upto) - 1).alias("drawdown"), sharpe.alias("rolling_sharpe"))


def summary(periods: DataFrame, freq: int = 5) -> DataFrame:
    """(ann_return, ann_vol, sharpe, sortino, calmar, max_drawdown, periods) in one row."""
    c = curve(periods, freq)
    year = YEAR / freq
    ret, vol = F.avg("net") * year, F.stddev_samp("net") * year**0.5
    down = F.stddev_samp(F.when(F.col("net") < 0, F.col("net"))) * year**0.5
    low = F.min("drawdown")
    return c.agg(ret.alias("ann_return"), vol.alias("ann_vol"), F.try_divide(ret, vol).alias("sharpe"), F.try_divide(ret, down).alias("sortino"), F.try_divide(ret, F.abs(low)).alias("calmar"), low.alias("max_drawdown"), F.count(F.lit(1)).alias("periods"))


def turnover(scores: DataFrame, top_k: int = 40, freq: int = 5) -> DataFrame:
    """(date, turnover): half the sum of absolute weight changes between successive rebalances; the first has none.

    A change needs a weight at either rebalance, so each weight is put against the next rebalance
    by position: one shuffle by security, no join of all names.
    """
    t = tails(every(scores.where("score is not null"), freq), top_k)
    days = t.select("date").distinct().select("date", F.row_number().over(W.orderBy("date")).alias("p"))
    held = t.join(F.broadcast(days), "date").select("security_id", "p", (F.col("side") / F.lit(float(top_k))).alias("w"))
    steps = held.select("security_id", F.explode(F.array(F.struct(F.col("p").alias("p"), F.col("w").alias("d")), F.struct((F.col("p") + 1).alias("p"), (-F.col("w")).alias("d")))).alias("x")).groupBy("security_id", "x.p").agg(F.sum("x.d").alias("d"))
    per = steps.groupBy("p").agg((F.sum(F.abs("d")) / 2).alias("turnover")).where("p > 1")
    return per.join(F.broadcast(days), "p").select("date", "turnover")


def annual(df: DataFrame, column: str, freq: int = 5) -> DataFrame:
    return df.agg((F.avg(column) * YEAR / freq).alias("value"))


def top_beats_bottom(df: DataFrame, n: int = 10, freq: int = 5, min_stocks: int = 20) -> DataFrame:
    """(value): share of rebalance days on which the top bucket's mean label exceeds the bottom's."""
    from rankloom.operators.metrics import decile_spread

    _, days = decile_spread(every(df, freq), n=n, min_stocks=min_stocks)
    return days.agg(F.avg((F.col("spread") > 0).cast("double")).alias("value"))


@register("backtest", "long_short")
class LongShort:
    def __init__(self, top_k: int = 40, freq: int = 5, cost_bps: float = 10.0):
        self.top_k, self.freq, self.cost_bps = top_k, freq, cost_bps

    def run(self, scores: DataFrame, load_returns: Callable[[], DataFrame]) -> BacktestResult:
        p = long_short_periods(scores, load_returns(), self.top_k, self.freq, self.cost_bps)
        return BacktestResult(curve(p, self.freq), summary(p, self.freq), tails(every(scores, self.freq), self.top_k))


@register("backtest", "placeholder")
class Placeholder:
    """Declares the interface only; a run records the stage as skipped."""

    def run(self, scores: DataFrame, load_returns: Callable[[], DataFrame]) -> BacktestResult:
        raise NotImplementedError("no backtest engine is chosen")

