"""Rolling totals over trailing periods, kept as versioned daily state.

The state of an entity on a day is the day's own amounts (number of rows, of usable values and their sum) and,
for each period, the same three as totals over the period.  It follows from the day before by

    today's totals = yesterday's totals + today's arrivals - the amounts of the day that expires.

``advance`` is this join: yesterday's totals, the arrivals and the expiring days' amounts (both by entity) meet in one
shuffle, and running sums carry them over the days of the span, one day in daily work, a quarter when a history is loaded.
Sums are DECIMAL, so an amount that expires leaves nothing behind.

Because totals are sums, states add: rows that arrive late, for whatever day, form a small state of their own over the
days they affect; ``RollingStore.correct`` reads the stored state of these days only, adds, and writes these days
as the next version.  Rows are reduced to (entity, day) on the map side first, so an
entity with a third of all rows comes to one row a day before anything is ordered.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.session import finite

PERIODS = (7, 30)
MONEY = "decimal(28,12)"
TOTAL = "decimal(38,12)"
OWN = ("n_d", "c_d", "s_d")
_DAY_0 = dt.date(1970, 1, 1)


def _names(periods: Sequence[int]) -> list[str]:
    return [f"{c}_{w}" for w in periods for c in ("n", "c", "s")]


def _kind(column: str) -> str:
    return TOTAL if column[0] == "s" else "long"


def daily_amounts(df: DataFrame, entity: str, day: str, value: str, *also: str) -> DataFrame:
    """(k, d, *also, n, c, s): rows, usable values and their sum; NULL keys and days are left out, NaN and infinities are no value."""
    return (
        df.select(F.col(entity).alias("k"), F.unix_date(F.col(day).cast("date")).alias("d"), *also, finite(value).cast(MONEY).alias("v"))
        .where(F.col("k").isNotNull() & F.col("d").isNotNull())
        .groupBy("k", "d", *also)
        .agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("c"), F.coalesce(F.sum("v"), F.lit(0)).cast(TOTAL).alias("s"))
    )


def _carried(rows: DataFrame, periods: Sequence[int], start: int | None, upto: int | None) -> DataFrame:
    """The state on each day from running sums; days on which all periods are empty are left out.

    Of the rows (k, d, kind, n, c, s, totals), those of kind 0 are totals to begin with on their day; a day's amounts
    (kind 2) are a change on the day itself and an opposite one, for each period, on the day they expire, the amounts of days before
    ``start`` (kind 1) only the latter.  The state goes on to the day ``upto``, or to the day before the last amounts expire.

    The rows are shuffled once, by entity and before they are multiplied; sums and windows then find them in place.
    """
    names = _names(periods)
    ways = F.concat(F.when(F.col("kind") == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(0))), F.when(F.col("kind") > 0, F.array(*[F.lit(w) for w in periods])).otherwise(F.array().cast("array<int>")))
    e = rows.repartition("k").select("*", F.explode(ways).alias("w")).withColumn("d", F.col("d") + F.col("w"))
    if start is not None:
        e = e.where((F.col("d") >= start) & (F.col("d") <= upto))
    came = F.col("w") == 0
    own = [F.sum(F.when(came & (F.col("kind") == 2), F.col(o[0]))).alias(o) for o in OWN]
    change = [F.sum(F.when(F.col("kind") == 0, F.col(x)).when(came, F.col(x[0])).when(F.col("w") == int(x[2:]), -F.col(x[0]))).alias(x) for x in names]
    changes = e.groupBy("k", "d").agg(*own, *change)
    w = W.partitionBy("k").orderBy("d")
    until = F.lead("d").over(w) - 1
    states = changes.select("k", "d", *OWN, (until if upto is None else F.coalesce(until, F.lit(upto))).alias("until"), *[F.coalesce(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).cast(_kind(x)).alias(x) for x in names])
    days = states.where(F.col("until").isNotNull() & (F.col(f"n_{max(periods)}") > 0)).select("*", F.explode(F.sequence("d", "until")).alias("day"))
    return days.select("k", F.col("day").alias("d"), *[F.coalesce(F.when(F.col("day") == F.col("d"), F.col(c)), F.lit(0)).cast(_kind(c)).alias(c) for c in OWN], *names)


def _amounts(daily: DataFrame, kind: int, periods: Sequence[int]) -> DataFrame:
    return daily.select("k", "d", F.lit(kind).alias("kind"), "n", "c", "s", *[F.lit(None).cast(_kind(x)).alias(x) for x in _names(periods)])


def advance(state: DataFrame, daily: DataFrame, start: int, upto: int, periods: Sequence[int] = PERIODS) -> DataFrame:
    """The state on the days start .. upto (days since 1970) from the state before: yesterday's totals, the arrivals of these days, and the amounts that expire on them.

    ``state`` needs the day before ``start`` for its totals and the ``max(periods)`` days before for their own amounts.
    """
    yesterday = state.where(F.col("d") == start - 1).select("k", F.lit(start).alias("d"), F.lit(0).alias("kind"), *[F.lit(None).cast(_kind(c)).alias(c[0]) for c in OWN], *_names(periods))
    before = state.where((F.col("d") >= start - max(periods)) & (F.col("d") < start) & (F.col("n_d") > 0)).select("k", "d", *[F.col(c).alias(c[0]) for c in OWN])
    came = daily.where((F.col("d") >= start) & (F.col("d") <= upto))
    return _carried(yesterday.unionByName(_amounts(before, 1, periods)).unionByName(_amounts(came, 2, periods)), periods, start, upto)


def step(yesterday: DataFrame, daily: DataFrame, day: int, periods: Sequence[int] = PERIODS) -> DataFrame:
    """The state on one day; ``yesterday`` holds the day before and the days that expire."""
    return advance(yesterday, daily, day, day, periods)


def state_of(daily: DataFrame, periods: Sequence[int] = PERIODS) -> DataFrame:
    """The state of a whole history at once, each entity's days from its first to the day before its last amounts expire."""
    return _carried(_amounts(daily, 2, periods), periods, None, None)


def corrected(state: DataFrame, delta: DataFrame, periods: Sequence[int] = PERIODS) -> DataFrame:
    """The days of ``delta`` after it is added to the state: states of disjoint sets of rows add up."""
    cols = [*OWN, *_names(periods)]
    rows = state.select("k", "d", *cols, F.lit(False).alias("new")).unionByName(delta.select("k", "d", *cols, F.lit(True).alias("new")))
    return rows.repartition("k").groupBy("k", "d").agg(*[F.sum(c).cast(_kind(c)).alias(c) for c in cols], F.max("new").alias("new")).where("new").drop("new")


def series(state: DataFrame, entity: str, periods: Sequence[int] = PERIODS) -> DataFrame:
    """(entity, day, then rows_w, total_w, mean_w for each period) for each day from the entity's first to its last day with rows.

    Days on which every period is empty have 0 rows, total 0 and a NULL mean.
    """
    w = W.partitionBy("k").orderBy("d")
    whole = W.partitionBy("k")
    s = state.select("*", F.max(F.when(F.col("n_d") > 0, F.col("d"))).over(whole).alias("last"), F.lead("d").over(w).alias("nxt")).where(F.col("d") <= F.col("last"))
    end = F.when(F.col("nxt") <= F.col("last"), F.col("nxt") - 1).otherwise(F.col("d"))
    s = s.select("*", F.explode(F.sequence("d", end)).alias("g"))
    own = F.col("g") == F.col("d")
    cols = []
    for p in periods:
        n, c, t = (F.when(own, F.col(f"{x}_{p}")).otherwise(0) for x in ("n", "c", "s"))
        cols += [n.cast("long").alias(f"rows_{p}"), t.cast("double").alias(f"total_{p}"), F.when(c > 0, t.cast("double") / c).alias(f"mean_{p}")]
    return s.select(F.col("k").alias(entity), F.date_from_unix_date("g").alias("day"), *cols)


def rolling_totals(df: DataFrame, entity: str, day: str, value: str, periods: Sequence[int] = PERIODS) -> DataFrame:
    """Totals of a whole history without a store: see series.  Rows with a NULL entity or day are left out, repeated rows count each, other columns are ignored."""
    return series(state_of(daily_amounts(df, entity, day, value), periods), entity, periods)


def month_of(d):
    """The partition of a day, as YYYYMM."""
    day = F.date_from_unix_date(d)
    return (F.year(day) * 100 + F.month(day)).cast("int")


def _months(lo: int, hi: int) -> list[int]:
    a, b = (_DAY_0 + dt.timedelta(days=x) for x in (lo, hi))
    return [m // 12 * 100 + m % 12 + 1 for m in range(a.year * 12 + a.month - 1, b.year * 12 + b.month)]


class ConcurrentWrite(RuntimeError):
    """Another writer has claimed the next version and not finished it."""


class RollingStore:
    """Versions of the state under one shared folder, partitioned by month.

    A version is a folder ``v<number>.<kind>.<last day>``: the days of an advance, the days that a correction affects
    as totals after it, or the whole of some months after a compaction.  The current state of a day is that of its highest version; months that
    have one version only are read as they are.  A version counts once Spark's _SUCCESS file is
    there and is never rewritten, so a job that dies leaves the last state intact.  A writer first claims the next number by
    creating a file that must not exist; a second one gets ConcurrentWrite.  What a dead writer claimed is given free by ``release``.
    """

    def __init__(self, spark: SparkSession, root: str, periods: Sequence[int] = PERIODS, kind: str = "long"):
        self.spark, self.root, self.periods = spark, root.rstrip("/"), tuple(periods)
        self.schema = f"k {kind}, d int, " + ", ".join(f"{c} {_kind(c)}" for c in (*OWN, *_names(self.periods))) + ", month int"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        at = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _all(self) -> list[tuple[int, str, int, str]]:
        """(number, kind, last day, folder) of the finished versions."""
        out = []
        for name in self._list(self.root):
            if name.startswith("v") and name.count(".") == 2 and self._fs.exists(self._path(f"{self.root}/{name}/_SUCCESS")):
                n, kind, last = name[1:].split(".")
                out.append((int(n), kind, int(last), name))
        return sorted(out)

    def versions(self) -> list[int]:
        return [v[0] for v in self._all()]

    def frontier(self) -> int | None:
        """The last day (days since 1970) that the state has reached."""
        return max((v[2] for v in self._all()), default=None)

    def _claim(self) -> int:
        done = {v[0] for v in self._all()}
        claimed = {int(n[1:]) for n in self._list(f"{self.root}/_claims") if n.startswith("v")}
        if claimed - done:
            raise ConcurrentWrite(f"version {max(claimed - done)} of {self.root} is claimed and not finished")
        new = max(done | {0}) + 1
        try:
            self._fs.create(self._path(f"{self.root}/_claims/v{new:08d}"), False).close()
        except Exception as e:
            raise ConcurrentWrite(f"version {new} of {self.root} was claimed by another writer") from e
        return new

    def release(self, version: int) -> None:
        """Give up a claim whose writer is dead, with what it had written."""
        if version in self.versions():
            raise ValueError(f"version {version} is finished")
        for name in self._list(self.root):
            if name.startswith(f"v{version:08d}."):
                self._fs.delete(self._path(f"{self.root}/{name}"), True)
        self._fs.delete(self._path(f"{self.root}/_claims/v{version:08d}"), False)

    def _write(self, state: DataFrame, kind: str, last: int) -> int:
        new = self._claim()
        try:
            state.withColumn("month", month_of("d")).write.partitionBy("month").parquet(f"{self.root}/v{new:08d}.{kind}.{last}")
        except BaseException:
            self.release(new)
            raise
        return new

    def current(self, upto: int | None = None, months: Sequence[int] | None = None) -> DataFrame:
        """The state as of a version (the newest without one), of some months or all; only these months' folders are read."""
        versions = [v for v in self._all() if upto is None or v[0] <= upto]
        have = {v[0]: {int(n[6:]) for n in self._list(f"{self.root}/{v[3]}") if n.startswith("month=")} for v in versions}
        wanted = sorted(set().union(*have.values()) & set(months)) if months is not None else sorted(set().union(*have.values()))
        sources: dict[int, list[int]] = {}
        for m in wanted:
            holding = [v for v in versions if m in have[v[0]]]
            base = max((v[0] for v in holding if v[1] == "compact"), default=0)
            sources[m] = [v[0] for v in holding if v[0] >= base]
        cols = [*OWN, *_names(self.periods)]

        def read(number: int, mine: list[int]) -> DataFrame:
            name = next(v[3] for v in versions if v[0] == number)
            return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}").where(F.col("month").isin(mine)).drop("month")

        def of(single: bool) -> list[DataFrame]:
            some = {m: s for m, s in sources.items() if (len(s) == 1) == single}
            return [read(v, mine).withColumn("version", F.lit(v)) for v in sorted({v for s in some.values() for v in s}) if (mine := [m for m, s in some.items() if v in s])]

        parts = [p.drop("version") for p in of(True)]
        if several := of(False):
            rows = reduce(lambda a, b: a.unionByName(b), several)
            newest = F.lead("d").over(W.partitionBy("k").orderBy("d", "version"))  # in the order that series needs anyway
            parts.append(rows.repartition("k").withColumn("next", newest).where("next is null or next <> d").select("k", "d", *cols))
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop("month")
        return reduce(lambda a, b: a.unionByName(b), parts)

    def advance(self, daily: DataFrame, upto: int, start: int | None = None) -> int:
        """Carries the state from the day after the frontier (``start`` in an empty store) to ``upto`` with the arrivals of these days; reads the months of the expiring days only."""
        last = self.frontier()
        start = last + 1 if last is not None else start if start is not None else upto
        if start > upto:
            raise ValueError(f"the state has reached day {last}; rows of earlier days are corrections")
        before = self.current(months=_months(start - max(self.periods), start - 1))
        return self._write(advance(before, daily, start, upto, self.periods), "advance", upto)

    def correct(self, daily: DataFrame) -> int | None:
        """Adds late amounts (of days up to the frontier) and writes the days they affect, as totals after the correction; only the months of these days are read."""
        last, top = self.frontier(), max(self.periods)
        # no month is shorter than 28 days, so steps of 28 days skip none
        months = sorted(r[0] for r in daily.select(F.explode(F.array(*[month_of(F.col("d") + o) for o in (*range(0, top - 1, 28), top - 1)])).alias("m")).distinct().collect())  # a few, whatever the rows
        if not months:
            return None
        latest = daily.agg(F.max("d")).first()[0]
        if last is None or latest > last:
            raise ValueError(f"rows of day {latest} are no correction: the state has reached day {last}")
        delta = state_of(daily, self.periods).where(F.col("d") <= last)
        return self._write(corrected(self.current(months=months), delta, self.periods), "correct", last)

    def add(self, daily: DataFrame) -> list[int]:
        """Amounts of any days: those up to the frontier as a correction, the later ones as an advance to their last day.  daily is read several times: hand over a stored table."""
        last = self.frontier()
        lo, hi = daily.agg(F.min("d"), F.max("d")).first()
        if lo is None:
            return []
        out = [self.correct(daily.where(F.col("d") <= last))] if last is not None and lo <= last else []
        if last is None or hi > last:
            out.append(self.advance(daily, hi, lo))
        return out

    def load(self, daily: DataFrame, lo: int, hi: int, days: int = 92) -> list[int]:
        """The days lo .. hi after the frontier in advances of ``days`` days each; daily should be stored by month, so that each reads its own part."""
        last = self.frontier()
        at = lo if last is None else last + 1
        out = []
        while at <= hi:
            upto = min(at + days - 1, hi)
            out.append(self.advance(daily.where(F.col("month").isin(_months(at, upto))) if "month" in daily.columns else daily, upto, at))
            at = upto + 1
        return out

    def compact(self, months: Sequence[int] | None = None) -> int:
        """One version of whole months, from which on reading starts; the versions before stay for reading as of them."""
        return self._write(self.current(months=months), "compact", self.frontier() or 0)

