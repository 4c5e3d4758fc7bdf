"""Feature windows of decision days, in long form, and the cross-sectional transforms on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom import registry
from rankloom.functions.columns import clip as clip_column
from rankloom.registry import register


@register("transform", "cs_zscore")
def cs_zscore(x: Column, real: Column, day: WindowSpec, eps: float = 1e-8, ddof: int = 1) -> Column:
    """Distance from the mean of the real slots' present values of the day, in standard deviations; NULL for ddof or fewer values."""
    v = F.when(real, x)
    sd = (F.stddev_samp if ddof == 1 else F.stddev_pop)(v).over(day)
    return F.when((F.count(v).over(day) > ddof) & real, (x - F.avg(v).over(day)) / (sd + F.lit(eps)))


@register("transform", "clip")
def clip(x: Column, real: Column, day: WindowSpec, lo: float = -3.0, hi: float = 3.0) -> Column:
    return clip_column(x, lo, hi)


@register("transform", "cs_rank")
def cs_rank(x: Column, real: Column, day: WindowSpec) -> Column:
    """Uniform rank in [-0.5, 0.5] among the real slots' present values, ties by slot; NULL for fewer than two."""
    v = F.when(real, x)
    n = F.count(v).over(day)
    return F.when((n >= 2) & v.isNotNull(), (F.row_number().over(day.orderBy(v.asc_nulls_last(), "slot")) - 1) / (n - 1) - F.lit(0.5))


FILLS = ("zero", "ffill")


def none_type(names: Sequence[str]) -> str:
    """The type of a day's features inside a window."""
    return "struct<at:int," + ",".join(f"`{n}`:double" for n in names) + ">"


def windows(slots: DataFrame, features: DataFrame, names: Sequence[str], lookback: int, max_missing: int = 2, fill: str = "zero", transforms: Sequence[dict] = (), raw: bool = False) -> DataFrame:
    """(date, day_idx, slot, security_id, lag, real, <names>): lags 0 .. lookback - 1 of each slot, the last being the day before the decision.

    slots: (date, day_idx, slot, security_id) per decision day; features: (security_id, day_idx, names).  A day
    counts as missing if any feature is; a slot is real if it has a name and at most ``max_missing``
    such days.  With fill='ffill' gaps take the last value inside the window.  Transforms see missing values
    as NULL and real slots only; afterwards what is missing or not real is 0 (left as it is with ``raw``).

    A security's days and its decisions meet in one shuffle by security, where each decision takes its window as an array;
    the mask and the filling are array operations on it.  Only then are the lags laid out as rows.  Statistics need the whole day's cross-section, so transforms cost one
    more shuffle, by (decision, lag).
    """
    if fill not in FILLS:
        raise ValueError(f"fill must be one of {', '.join(FILLS)}")
    d = slots.where(F.col("day_idx") >= lookback)
    cells = F.struct(F.col("day_idx").alias("at"), *[F.col(n).cast("double").alias(n) for n in names])
    none = F.lit(None).cast(none_type(names))
    known = features.where("security_id is not null").select("security_id", F.col("day_idx").cast("int").alias("day_idx"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("int").alias("slot"), cells.cast(none_type(names)).alias("v"))
    asked = d.where("security_id is not null").select("security_id", F.col("day_idx").cast("int").alias("day_idx"), "date", F.col("slot").cast("int").alias("slot"), none.alias("v"))
    before = W.partitionBy("security_id").orderBy("day_idx").rangeBetween(-lookback, -1)
    x = known.unionByName(asked).withColumn("held", F.collect_list("v").over(before)).where("slot is not null").drop("v")
    whole = lambda v: reduce(and_, [v[n].isNotNull() for n in names], F.lit(True))
    x = x.withColumn("real", F.lit(lookback) - F.size(F.filter("held", whole)) <= max_missing)
    # a place per lag: as they are if no day is absent, else looked up by their day
    at = F.map_from_entries(F.transform("held", lambda v: F.struct(v["at"] - F.col("day_idx") + lookback, v)))
    lags = F.sequence(F.lit(0), F.lit(lookback - 1))
    x = x.withColumn("held", F.when(F.size("held") == lookback, F.col("held")).otherwise(F.transform(lags, lambda i: F.try_element_at(at, i))))
    if fill == "ffill":
        step = lambda acc, v: F.array_append(acc, F.struct(v["at"].alias("at"), *[F.coalesce(v[n], F.try_element_at(acc, F.lit(-1))[n]).alias(n) for n in names]))
        x = x.withColumn("held", F.aggregate("held", F.array().cast(f"array<{none_type(names)}>"), step))
    pads = d.where("security_id is null").select("security_id", F.col("day_idx").cast("int").alias("day_idx"), "date", F.col("slot").cast("int").alias("slot"), F.array_repeat(none, lookback).alias("held"), F.lit(False).alias("real"))
    x = x.unionByName(pads).select("date", "day_idx", "slot", "security_id", "real", F.posexplode("held").alias("lag", "v"))
    x = x.select("date", "day_idx", "slot", "security_id", "lag", "real", *[F.col("v")[n].alias(n) for n in names])
    day = W.partitionBy("day_idx", "lag")
    for t in transforms:
        kw = dict(t.get("kwargs", {}))
        only = kw.pop("features", None) or names
        fn: Callable = registry.get("transform", t["func"])
        x = x.withColumns({n: fn(F.col(n), F.col("real"), day, **kw) for n in only})
    if not raw:
        x = x.withColumns({n: F.when(F.col("real"), F.coalesce(n, F.lit(0.0))).otherwise(F.lit(0.0)) for n in names})
    return x.select("date", "day_idx", "slot", "security_id", "lag", "real", *names)


def tensors(long: DataFrame, names: Sequence[str], lookback: int | None = None) -> DataFrame:
    """(date, slot, security_id, real, x): the window of each slot as array<array<float>> [lag][feature]; with ``lookback``, a window of another length is an error."""
    row = F.struct("lag", F.array(*[F.col(n).cast("float") for n in names]).alias("v"))
    out = long.groupBy("date", "day_idx", "slot", "security_id", "real").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias("x"))
    if lookback is None:
        return out
    wrong = F.raise_error(F.concat(F.lit(f"a window of {lookback} days was expected, not of "), F.size("x").cast("string")))
    return out.withColumn("x", F.when(F.size("x") == lookback, F.col("x")).otherwise(wrong.cast("array<array<float>>")))


def market_windows(decisions: DataFrame, market: DataFrame, cal: DataFrame, lookback: int) -> DataFrame:
    """(date, lag, ts__..., static__...): the market's own window, static columns as of the day before the decision; missing is 0."""
    ts, static = [c for c in market.columns if c.startswith("ts__")], [c for c in market.columns if c.startswith("static__")]
    m = market.join(F.broadcast(cal), "date").drop("date")
    d = decisions.select("date", "day_idx").distinct().where(F.col("day_idx") >= lookback)
    long = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(lookback - 1))).alias("lag"))
    a = m.select(F.col("day_idx").alias("at"), *ts)
    b = m.select((F.col("day_idx") + 1).alias("day_idx"), *static)
    out = long.withColumn("at", F.col("day_idx") - lookback + F.col("lag")).join(F.broadcast(a), "at", "left").join(F.broadcast(b), "day_idx", "left")
    return out.select("date", "lag", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (*ts, *static)])
