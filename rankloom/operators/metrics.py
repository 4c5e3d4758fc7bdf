"""Metrics of predictions (date, security_id, score, label): within each day first, then over days.

Every metric takes ``by``, further grouping columns (such as a fold); the value table then has
one row per group, and the whole evaluation of all folds is one pass per daily value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.columns import average_rank, bucket, correlation
from rankloom.registry import register


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("score").isNotNull() & F.col("label").isNotNull() & F.col("date").isNotNull())


def daily_ic(df: DataFrame, min_stocks: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by..., date, ic): Spearman correlation of score and label; days with fewer names, a constant score or label are left out.

    All windows share the partitioning by day, so ranks and correlation cost one shuffle.
    """
    key = [*by, "date"]
    ranked = _usable(df).select(*key, "score", average_rank(F.col("score"), key).alias("rs"), average_rank(F.col("label"), key).alias("rl"))
    days = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("score").alias("sd"), correlation(F.col("rs"), F.col("rl")).alias("ic"))
    return days.where((F.col("n") >= min_stocks) & (F.col("sd") >= 1e-12) & F.col("ic").isNotNull()).select(*key, "ic")


def _over(days: DataFrame, by: Sequence[str], value) -> DataFrame:
    return days.groupBy(*by).agg(value.alias("value")) if by else days.agg(value.alias("value"))


class DailyMetric:
    """A metric in two steps: one value per day (``daily``), and an aggregate of the days (``value``).

    Metrics whose first step is the same share it in ``evaluate``, which needs the rows of a day once for all folds.
    """

    def __init__(self, daily, value, shown: bool = True, defaults: dict | None = None, later: tuple[str, ...] = (), both: tuple[str, ...] = ()):
        self.daily, self.value, self.shown, self.defaults, self.later, self.both = daily, value, shown, defaults or {}, later, both
        self.__module__, self.__qualname__ = daily.__module__, daily.__qualname__

    def split(self, kw: dict) -> tuple[dict, dict]:
        """The arguments of the first and of the second step."""
        kw = {**self.defaults, **kw}
        return {k: v for k, v in kw.items() if k not in self.later}, {k: v for k, v in kw.items() if k in self.later or k in self.both}

    def __call__(self, df: DataFrame, *args, by: Sequence[str] = (), **kw) -> tuple[DataFrame, DataFrame | None]:
        first, second = self.split({**dict(zip(self.defaults, args)), **kw})
        days = self.daily(df, by=by, **first)
        return _over(days, by, self.value(**second)), days if self.shown else None


def _icir(periods_per_year: float | None = None):
    """Mean over standard deviation of the daily IC; NULL for fewer than two days or no spread."""
    sd = F.stddev_samp("ic")
    return F.try_divide(F.avg("ic"), F.when(sd > 0, sd)) * F.lit(float(periods_per_year) ** 0.5 if periods_per_year else 1.0)


mean_ic = register("metric", "mean_ic")(DailyMetric(daily_ic, lambda: F.avg("ic"), defaults={"min_stocks": 20}))
icir = register("metric", "icir")(DailyMetric(daily_ic, _icir, False, {"min_stocks": 20, "periods_per_year": None}, ("periods_per_year",)))
ic_hit_rate = register("metric", "ic_hit_rate")(DailyMetric(daily_ic, lambda: F.avg((F.col("ic") > 0).cast("double")), False, {"min_stocks": 20}))


def with_buckets(df: DataFrame, n: int, min_stocks: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds bucket 1..n by score (ties by security_id) on days with enough names."""
    key = [*by, "date"]
    w = W.partitionBy(*key)
    rows = _usable(df).withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy("score", "security_id"))})
    return rows.where(F.col("_n") >= min_stocks).withColumn("bucket", bucket(F.col("_r"), F.col("_n"), n)).drop("_n", "_r")


def daily_spread(df: DataFrame, n: int = 10, cost_bps: float = 0.0, min_stocks: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by..., date, spread): mean label of the top less the bottom bucket, net of costs; days that lack either are left out."""
    mean = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("label")))
    return with_buckets(df, n, min_stocks, by).groupBy(*by, "date").agg((mean(n) - mean(1) - F.lit(cost_bps / 1e4)).alias("spread")).where("spread is not null")


decile_spread = register("metric", "decile_spread")(DailyMetric(daily_spread, lambda: F.avg("spread"), defaults={"n": 10, "cost_bps": 0.0, "min_stocks": 20}))


def bucket_profile(df: DataFrame, n: int = 10, min_stocks: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bucket, label): mean over days of the buckets' mean labels."""
    return with_buckets(df, n, min_stocks, by).groupBy(*by, "date", "bucket").agg(F.avg("label").alias("m")).groupBy(*by, "bucket").agg(F.avg("m").alias("label"))


def quantile_buckets(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds bucket 1..n cut at the day's linearly interpolated score quantiles, upper ends included; equal cuts leave buckets empty."""
    key = [*by, "date"]
    cuts = _usable(df).groupBy(*key).agg(F.percentile("score", F.array(*[F.lit(i / n) for i in range(1, n)])).alias("_cuts"))
    rows = _usable(df).join(F.broadcast(cuts), key)
    return rows.withColumn("bucket", F.size(F.filter("_cuts", lambda c: F.col("score") > c)) + 1).drop("_cuts")


def rolling_mean(days: DataFrame, value: str, window: int = 20) -> DataFrame:
    """(date, mean, running): mean of the last ``window`` days once there are as many, and the running sum; one row a day."""
    w = W.orderBy("date")
    last = w.rowsBetween(-(window - 1), 0)
    return days.select("date", F.when(F.count(value).over(last) == window, F.avg(value).over(last)).alias("mean"), F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("running"))


def bucket_columns(df: DataFrame, n: int, min_stocks: int = 20) -> DataFrame:
    """(date, b1 .. bn): the buckets' mean labels side by side."""
    b = with_buckets(df, n, min_stocks)
    return b.groupBy("date").agg(*[F.avg(F.when(F.col("bucket") == i, F.col("label"))).alias(f"b{i}") for i in range(1, n + 1)])


def daily_profile(df: DataFrame, n: int = 10, min_stocks: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(by..., date, means): the buckets' mean labels side by side, as an array."""
    days = with_buckets(df, n, min_stocks, by).groupBy(*by, "date").agg(*[F.avg(F.when(F.col("bucket") == i, F.col("label"))).alias(f"b{i}") for i in range(1, n + 1)])
    return days.select(*by, "date", F.array(*[f"b{i}" for i in range(1, n + 1)]).alias("means"))


def _monotonicity(n: int = 10):
    """Spearman correlation of the bucket's number with its mean label over the days; buckets without any label are left out."""
    mean = F.filter(F.array(*[F.avg(F.get("means", F.lit(i))) for i in range(n)]), lambda m: m.isNotNull())
    place = F.transform(mean, lambda m, i: (i + 1).cast("double"))
    # the average rank: how many are smaller, and half of those that are equal
    rank = F.transform(mean, lambda m: F.size(F.filter(mean, lambda o: o < m)) + (F.size(F.filter(mean, lambda o: o == m)) + 1) / 2)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    centred = lambda a: F.transform(a, lambda v: v - total(a) / F.size(a))
    x, y = centred(place), centred(rank)
    product = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))
    return F.try_divide(product(x, y), F.sqrt(product(x, x) * product(y, y)))


decile_monotonicity = register("metric", "decile_monotonicity")(DailyMetric(daily_profile, _monotonicity, False, {"n": 10, "min_stocks": 20}, both=("n",)))


def evaluate(predictions: DataFrame, labels: DataFrame, specs: Sequence[dict]) -> tuple[DataFrame, DataFrame]:
    """((fold, metric, value), (fold, date, metric, value)) for fold 'all' and each fold of the predictions.

    A day lies in one fold, so each day is worked off once per first step, however many metrics share it; the days then count for their fold and for 'all'.
    """
    from rankloom import registry

    j = predictions.join(labels.where("label is not null"), ["date", "security_id"])
    first: dict[str, tuple[DataFrame, list]] = {}
    shown = None
    for s in specs:
        kw = dict(s.get("kwargs", {}))
        name = kw.pop("alias", None) or s["func"]
        m = registry.get("metric", s["func"])
        a, b = m.split(kw)
        key = f"{m.daily.__name__} {sorted(a.items())}"
        if key not in first:
            days = m.daily(j, by=["fold"], **a)
            first[key] = (days.withColumn("fold", F.explode(F.array(F.lit("all"), F.col("fold")))), [])
        first[key][1].append((name, m.value(**b)))
        if m.shown:
            d = first[key][0].select("fold", "date", F.lit(name).alias("metric"), F.col(first[key][0].columns[-1]).alias("value"))
            shown = d if shown is None else shown.unionByName(d)
    values = None
    for days, columns in first.values():
        wide = days.groupBy("fold").agg(*[c.cast("double").alias(f"m{i}") for i, (_, c) in enumerate(columns)])
        v = wide.select("fold", F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, (name, _) in enumerate(columns)])).alias("x")).select("fold", "x.metric", "x.value")
        values = v if values is None else values.unionByName(v)
    return values, shown
