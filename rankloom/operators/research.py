"""Analyses of rankings: Kendall's tau, decay, inference, neutralisation, regimes, rolling regressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.columns import clip, log1p_return, rolling
from rankloom.session import written


def _swaps(x: np.ndarray) -> int:
    """Pairs i < j with x[i] > x[j], by merging sorted halves bottom-up."""
    n, total, width = len(x), 0, 64
    x = x.copy()
    # blocks of 64 by comparing every place with every later one, all blocks at once; ranks fill the last block up from above
    rank = np.searchsorted(np.unique(x), x)
    padded = np.full(-(-n // width) * width, n)
    padded[:n] = rank
    rows = padded.reshape(-1, width)
    for k in range(1, width):
        total += int(np.count_nonzero(rows[:, :-k] > rows[:, k:]))
    x[:] = np.sort(rows, axis=1).ravel()[:n] if n else x
    while width < n:
        for a in range(0, n, 2 * width):
            left, right = x[a : a + width], x[a + width : a + 2 * width]
            if len(right):
                total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
                x[a : a + 2 * width] = np.sort(x[a : a + 2 * width], kind="stable")
        width *= 2
    return total


def tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in n log n: pairs out of order by counting merges, ties by counting runs; NaN if a side is constant."""
    n = len(x)
    if n < 2:
        return math.nan
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    pairs = n * (n - 1) // 2
    runs = lambda *c: int(sum(k * (k - 1) // 2 for k in np.diff(np.flatnonzero(np.r_[True, np.any([a[1:] != a[:-1] for a in c], axis=0), True])).tolist()))
    tx, both = runs(x), runs(x, y)
    ty = runs(np.sort(y))
    bottom = math.sqrt(float(pairs - tx) * float(pairs - ty))
    return (pairs - tx - ty + both - 2 * _swaps(y)) / bottom if bottom else math.nan


def daily_tau(df: DataFrame, min_stocks: int = 21, by: Sequence[str] = ()) -> DataFrame:
    """(by..., date, tau) for days with at least min_stocks names and a score that varies.

    A day's cross-section (two numbers per name) goes to one task, which needs n log n steps; pairs are never formed.
    """
    key = [*by, "date"]
    rows = df.where("score is not null and label is not null").select(*key, F.col("score").cast("double").alias("score"), F.col("label").cast("double").alias("label"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in key) + ", tau double"

    def one(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        s, y = p["score"].to_numpy(), p["label"].to_numpy()
        ok = len(p) >= min_stocks and s.std(ddof=1) > 1e-6
        t = tau_b(s, y) if ok else math.nan
        return pd.DataFrame([[*k, t]] if not math.isnan(t) else [], columns=[*key, "tau"])

    return rows.groupBy(*key).applyInPandas(one, schema)


def kendall_summary(days: DataFrame, per_year: float = 252.0) -> DataFrame:
    """(mean_tau, tau_ir, cum_tau) of a series of daily taus."""
    return days.agg(F.avg("tau").alias("mean_tau"), (F.try_divide(F.avg("tau"), F.stddev_samp("tau")) * F.lit(math.sqrt(per_year))).alias("tau_ir"), F.sum("tau").alias("cum_tau"))


def alpha_decay(df: DataFrame, lags: Sequence[int] = range(1, 11), min_stocks: int = 21) -> DataFrame:
    """(lag, mean_tau): tau of today's score with the target so many records later; 0 where no day qualifies.

    All leads come from one window per security; the lags are then exploded, not looped over.
    """
    w = W.partitionBy("security_id").orderBy("date")
    wide = df.select("date", "score", *[F.lead("label", n).over(w).alias(f"l{n}") for n in lags])
    long = wide.select("date", "score", F.explode(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"l{n}").alias("label")) for n in lags])).alias("x")).select("x.lag", "date", "score", "x.label")
    got = daily_tau(long, min_stocks, ["lag"]).groupBy("lag").agg(F.avg("tau").alias("m"))
    every = df.sparkSession.createDataFrame([(int(n),) for n in lags], "lag int")
    return every.join(got, "lag", "left").select("lag", F.coalesce("m", F.lit(0.0)).alias("mean_tau"))


def horizon_retention(df: DataFrame, returns: DataFrame, horizons: Sequence[int] = (1, 5, 10), min_stocks: int = 21) -> DataFrame:
    """(horizon, mean_tau, retention): mean tau of the score with the next h records' summed return, over days on which all horizons have one."""
    w = W.partitionBy("security_id").orderBy("date")
    ahead = lambda h: w.rowsBetween(1, h)
    sums = returns.select("date", "security_id", *[F.when(F.count("log_ret").over(ahead(h)) == h, F.sum("log_ret").over(ahead(h))).alias(f"h{h}") for h in horizons])
    j = df.select("date", "security_id", "score").join(sums.dropna(subset=[f"h{h}" for h in horizons]), ["date", "security_id"])
    long = j.select("date", "score", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("label")) for h in horizons])).alias("x")).select("x.horizon", "date", "score", "x.label")
    taus = daily_tau(long, min_stocks, ["horizon"])
    whole = taus.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("date"))).where(F.col("n") == len(horizons))
    mean = whole.groupBy("horizon").agg(F.avg("tau").alias("mean_tau"))
    first = F.max(F.when(F.col("horizon") == min(horizons), F.col("mean_tau"))).over(W.partitionBy())  # over one row per horizon
    return mean.select("horizon", "mean_tau", (F.try_divide(F.col("mean_tau"), first) * 100).alias("retention"))


def newey_west(series: DataFrame, value: str, lags: int = 5) -> DataFrame:
    """(n, mean, t_stat, share_positive) of a daily series, with Bartlett weights; one row per day, so ordering it is small."""
    w = W.orderBy("date")
    m = series.where(F.col(value).isNotNull()).select("date", F.col(value).alias("v"))
    e = m.select("date", "v", (F.col("v") - F.avg("v").over(W.partitionBy())).alias("e"))
    e = e.select("v", "e", *[F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1)])
    n = F.count(F.lit(1))
    lrv = F.sum(F.col("e") * F.col("e")) / n
    for k in range(1, lags + 1):
        lrv = lrv + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)) / n
    return e.agg(n.alias("n"), F.avg("v").alias("mean"), F.try_divide(F.avg("v"), F.sqrt(F.when(lrv > 0, lrv) / n)).alias("t_stat"), F.avg((F.col("v") > 0).cast("double")).alias("share_positive"))


GAMMA = 0.5772156649  # fixed value: Euler's constant


def expected_best(trials: int, variance: float) -> float:
    """Expected highest Sharpe ratio of so many trials without skill."""
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - GAMMA) * z(1 - 1 / trials) + GAMMA * z(1 - 1 / (trials * math.e)))


def deflated_sharpe(periods: DataFrame, column: str, trials: int, trial_variance: float, freq: int = 5) -> DataFrame:
    """(sharpe, stat, n): the annualised Sharpe ratio against the best of ``trials`` by chance, in standard errors (population skew, plain kurtosis)."""
    year = 252 / freq
    sr = F.try_divide(F.avg(column) * year, F.stddev_samp(column) * math.sqrt(year))
    g3, g4 = F.skewness(column), F.kurtosis(column) + 3
    bottom = F.sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr)
    return periods.agg(sr.alias("sharpe"), F.try_divide((sr - F.lit(expected_best(trials, trial_variance))) * F.sqrt(F.count(column)), bottom).alias("stat"), F.count(column).alias("n"))


def probability(stats: DataFrame, column: str = "stat") -> DataFrame:
    """Adds ``probability``: that a standard normal value lies below the statistic; NULL stays NULL.  The statistics are few, one a strategy."""

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(probability=[None if v is None or v != v else NormalDist().cdf(v) for v in b[column]])

    return stats.mapInPandas(below, ", ".join(f"`{n}` {t}" for n, t in stats.dtypes) + ", probability double")


BLOCK = 16  # vectors carried through a pass over the cells
CELLS = 2_000_000  # of the dense blocks that a task makes at a time


def _dense(b: pa.RecordBatch, n_days: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, centred rows security x day) of a batch of ``cells``, a bounded number of cells at a time."""
    size = b["c"].value_lengths().to_numpy()
    flat = b["c"].flatten()
    day, x = flat.field("day_idx").to_numpy(), flat.field("x").to_numpy()
    ends = np.concatenate([[0], np.cumsum(size)])
    step = max(1, CELLS // n_days)
    for k in range(0, len(size), step):
        part = slice(ends[k], ends[min(k + step, len(size))])
        n = len(size[k : k + step])
        row = np.repeat(np.arange(n), size[k : k + step])
        m = np.bincount(row * n_days + day[part], weights=x[part], minlength=n * n_days).reshape(n, n_days)
        yield k, m - m.mean(axis=1, keepdims=True)


def _spread(cells: DataFrame, n_days: int, u: np.ndarray) -> np.ndarray:
    """X X' u and, as last column, X 1, for the centred matrix X of days x securities; one pass, and one row a day to the driver."""
    width = u.shape[1] + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros((n_days, width))
        seen = False
        for b in batches:
            for _, m in _dense(b, n_days):
                y += m.T @ np.column_stack([m @ u, np.ones(len(m))])
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_days), pa.int32()), *(pa.array(y[:, j]) for j in range(width))], names=["d", *(f"y{j}" for j in range(width))])

    got = cells.mapInArrow(part, "d int, " + ", ".join(f"y{j} double" for j in range(width))).groupBy("d").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).toPandas()
    return got.sort_values("d")[[f"y{j}" for j in range(width)]].to_numpy().reshape(n_days, width)


def _orthonormal(new: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """Orthonormal columns for what ``new`` has outside ``basis``; directions below rounding of ``scale`` are left out."""
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
    q, s, _ = np.linalg.svd(new, full_matrices=False)
    q = q[:, s > 1e-12 * scale]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def market_mode(returns: DataFrame, rounds: int | None = None, value: str = "log_ret", tol: float = 1e-8) -> DataFrame:
    """(security_id, loading): first principal component of the date x security matrix, missing cells 0, columns centred, the loadings' sum not negative.

    Block Lanczos iteration over the days, with full reorthogonalisation: each pass reads the cells once and sums one row
    per day, so that small gaps between eigenvalues take few passes.  It ends when the residual bounds the angle to the true
    component by ``tol`` (residual <= tol x gap to the second eigenvalue), or is at rounding error of the eigenvalue; that is
    reached at the latest when the basis spans all days.  ``rounds`` bounds the passes; a RuntimeError tells when it is hit before.
    If the two largest eigenvalues are equal, any component of theirs is returned.

    A task holds BLOCK + 1 numbers per day and CELLS cells; the whole matrix is never formed.  The driver holds two
    days x BLOCK matrices per pass.
    """
    from rankloom.session import finite, written

    x = written(returns.select("date", "security_id", finite(value).alias("x")).where("date is not null and security_id is not null"), "mode-cells")
    days = x.select("date").distinct().select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("day_idx"))  # one row a day
    n_days = days.count()
    kept = x.where("x is not null").join(F.broadcast(days), "date")
    cells = written(kept.groupBy("security_id").agg(F.collect_list(F.struct("day_idx", "x")).alias("c")), "mode-rows")
    u, size, done, k = np.zeros(n_days), 0.0, n_days == 0, 0
    basis, image = np.zeros((n_days, 0)), np.zeros((n_days, 0))
    new = np.random.default_rng(0).normal(size=(n_days, min(BLOCK, n_days)))
    new = np.linalg.qr(new)[0] if n_days else new
    while not done:
        if rounds is not None and k >= rounds:
            raise RuntimeError(f"market_mode: not converged to {tol} after {rounds} rounds")
        k += 1
        got = _spread(cells, n_days, new)
        ones = got[:, -1]
        basis, image = np.column_stack([basis, new]), np.column_stack([image, got[:, :-1]])
        h = basis.T @ image
        value_of, y = np.linalg.eigh((h + h.T) / 2)
        top = float(value_of[-1])
        if top <= 0:
            break
        u = basis @ y[:, -1]
        residual = float(np.linalg.norm(image @ y[:, -1] - top * u))
        gap = top - max(float(value_of[-2]) if len(value_of) > 1 else 0.0, 0.0)
        new = _orthonormal(got[:, :-1], basis, top)
        done = residual <= max(tol * gap, 1e-13 * top) or not new.shape[1] or basis.shape[1] >= n_days
        size = math.sqrt(top)
    u = u / size * (-1 if u @ ones < 0 else 1) if size else u

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [m @ u for _, m in _dense(b, n_days)]
            yield pa.RecordBatch.from_arrays([b["security_id"], pa.array(np.concatenate(v) if v else np.zeros(0))], names=["security_id", "loading"])

    return cells.mapInArrow(load, f"security_id {cells.schema['security_id'].dataType.simpleString()}, loading double")


def neutral_scores(df: DataFrame, loadings: DataFrame) -> DataFrame:
    """(date, security_id, score, label): per day the residual of the score on a constant and the loading."""
    j = df.join(loadings, "security_id").where("score is not null and loading is not null")
    day = W.partitionBy("date")
    slope = F.coalesce(F.try_divide(F.covar_pop("loading", "score").over(day), F.var_pop("loading").over(day)), F.lit(0.0))
    return j.select("date", "security_id", (F.col("score") - F.avg("score").over(day) - slope * (F.col("loading") - F.avg("loading").over(day))).alias("score"), "label")


def volatility_regimes(df: DataFrame, column: str, window: int = 60) -> DataFrame:
    """(date, market_vol, regime): the day's median, its rolling median over ``window`` days, High_Vol where that exceeds its median over all rows."""
    per = df.groupBy("date").agg(F.median(column).alias("m"), F.count(F.lit(1)).alias("n"), F.count(column).alias("k")).where("k > 0")
    w = W.orderBy("date").rowsBetween(-(window - 1), 0)  # one row a day
    held = F.array_sort(F.collect_list("m").over(w))
    k = F.size(held)
    mid = (F.element_at(held, ((k + 1) / 2).cast("int")) + F.element_at(held, (k / 2).cast("int") + 1)) / 2
    days = per.select("date", "n", F.when(F.count("m").over(w) == window, mid).alias("market_vol"))
    level = days.agg(F.percentile("market_vol", F.lit(0.5), F.col("n")).alias("level"))  # days weighted by their rows
    return days.join(F.broadcast(level)).select("date", "market_vol", F.when(F.coalesce(F.col("market_vol") > F.col("level"), F.lit(False)), "High_Vol").otherwise("Low_Vol").alias("regime"))


def quantile_cuts(df: DataFrame, column: str, q: Sequence[float]) -> DataFrame:
    """(date, cuts): the day's linearly interpolated quantiles."""
    return df.where(F.col(column).isNotNull()).groupBy("date").agg(F.percentile(column, F.array(*[F.lit(float(x)) for x in q])).alias("cuts"))


def volatility_factor(df: DataFrame, column: str, ret: str = "log_ret", buckets: int = 5) -> DataFrame:
    """(date, factor): mean return of the lowest volatility bucket less that of the highest, buckets cut at the day's quantiles."""
    j = df.join(F.broadcast(quantile_cuts(df, column, [i / buckets for i in range(1, buckets)])), "date")
    low, high = F.col(column) <= F.element_at("cuts", 1), F.col(column) > F.element_at("cuts", buckets - 1)
    return j.groupBy("date").agg((F.avg(F.when(low, F.col(ret))) - F.avg(F.when(high, F.col(ret)))).alias("factor"))


def densify(panel: DataFrame, cal: DataFrame, values: Sequence[str], min_days: int = 0) -> DataFrame:
    """(date, security_id, values...): each security on every calendar day from its first record on, gaps carrying the last value.

    The days between two records are generated from the pair; the grid is not cross-joined.  Securities with fewer than min_days days are left out.
    """
    x = panel.join(F.broadcast(cal), "date")
    last = F.broadcast(cal.agg(F.max("day_idx").alias("end")))
    w = W.partitionBy("security_id").orderBy("day_idx")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    x = x.where("security_id is not null").select("security_id", "day_idx", *[F.last(v, ignorenulls=True).over(upto).alias(v) for v in values], (F.lead("day_idx").over(w) - 1).alias("to"), F.min(F.when(F.col(values[0]).isNotNull(), F.col("day_idx"))).over(W.partitionBy("security_id")).alias("begin"))
    x = x.join(last).where("begin is not null and day_idx >= begin").where(F.col("end") - F.col("begin") + 1 >= min_days)
    x = x.select("security_id", *values, F.explode(F.sequence("day_idx", F.coalesce("to", "end"))).alias("day_idx"))
    return x.join(F.broadcast(cal), "day_idx").select("date", "security_id", *values)


def strict_intersection(df: DataFrame) -> DataFrame:
    """Rows of the securities with a row on as many days as any has, on the days on which all of these have one."""
    n = df.groupBy("security_id").agg(F.count(F.lit(1)).alias("n"))
    best = n.join(F.broadcast(n.agg(F.max("n").alias("top")))).where("n = top").select("security_id")
    kept = df.join(best, "security_id", "left_semi")
    size = best.agg(F.count(F.lit(1)).alias("k"))
    days = kept.groupBy("date").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(size)).where("c = k").select("date")
    return kept.join(F.broadcast(days), "date", "left_semi")


def stock_ids(df: DataFrame, name: str) -> DataFrame:
    """(name, stock_id): the distinct names numbered from 0 in their order.

    Names are parted into ranges and numbered within each; the parts' sizes, one row a part, give where each begins.
    """
    parts = df.select(name).where(F.col(name).isNotNull()).distinct().repartitionByRange(name).select(name, F.spark_partition_id().alias("part"))
    parts = written(parts, "names")  # parts must not change between the two readings
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    return parts.join(F.broadcast(before), "part").select(name, (F.col("first") + F.row_number().over(W.partitionBy("part").orderBy(name)) - 1).alias("stock_id"))


def legacy_features(panel: DataFrame, bounds: tuple[float, float] = (-0.5, 0.5), vol_n: int = 60, short: int = 20, long: int = 60) -> DataFrame:
    """Clipped log return, its rolling deviation and the distances from two moving averages, per record."""
    r = clip(F.log(F.try_divide(F.col("close"), F.lag("close").over(W.partitionBy("security_id").orderBy("date")))), *bounds)
    x = panel.select("date", "security_id", "close", r.alias("log_ret"))
    return x.select("date", "security_id", "log_ret", rolling(F.stddev_samp, F.col("log_ret"), vol_n).alias("vol"), (F.try_divide(F.col("close"), rolling(F.avg, F.col("close"), short)) - 1).alias("dsma_short"), (F.try_divide(F.col("close"), rolling(F.avg, F.col("close"), long)) - 1).alias("dsma_long"))


def day_zscores(df: DataFrame, columns: Sequence[str], bound: float = 3.0) -> DataFrame:
    """Each column as clipped distance from the day's mean in sample deviations (+1e-8); rows with a missing one are left out."""
    day = W.partitionBy("date")
    z = {c: clip((F.col(c) - F.avg(c).over(day)) / (F.stddev_samp(c).over(day) + F.lit(1e-8)), -bound, bound) for c in columns}
    return df.withColumns(z).dropna(subset=list(columns))


def _ols_paths(r: np.ndarray, f: np.ndarray, window: int, horizon: int) -> np.ndarray:
    """Residual forward return at each t: compounded r over the next ``horizon`` less beta (from the ``window`` before t) times the compounded factors."""
    n, k = f.shape
    out = np.full(n, np.nan)
    if n < window + horizon:
        return out
    x = np.column_stack([np.ones(n), f])
    at = np.arange(window, n - horizon)
    xx = np.concatenate([np.zeros((1, k + 1, k + 1)), np.cumsum(x[:, :, None] * x[:, None, :], axis=0)])
    xy = np.concatenate([np.zeros((1, k + 1)), np.cumsum(x * r[:, None], axis=0)])
    a, b = xx[at] - xx[at - window], xy[at] - xy[at - window]
    beta = np.einsum("tij,tj->ti", np.linalg.pinv(a), b)
    grown = lambda v: np.lib.stride_tricks.sliding_window_view(1 + v, horizon, axis=0).prod(axis=-1)[at + 1] - 1
    grow_r, grow_f = grown(r), grown(f)
    out[at] = grow_r - (beta[:, 0] + (beta[:, 1:] * grow_f).sum(axis=1))
    return out


def rolling_ols_residual(df: DataFrame, ret: str, factors: Sequence[str], window: int = 126, horizon: int = 5) -> DataFrame:
    """(date, security_id, residual): the part of the next returns that a rolling regression on the factors does not explain.

    One Arrow group per security with one row per day, so its size is the number of days; all windows of a
    security are solved together from running sums.
    """
    rows = df.select("date", "security_id", F.col(ret).cast("double").alias("_r"), *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(factors)]).dropna()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date")
        v = _ols_paths(p["_r"].to_numpy(), p[[f"_f{i}" for i in range(len(factors))]].to_numpy(), window, horizon)
        return pd.DataFrame({"date": p["date"], "security_id": p["security_id"], "residual": v}).dropna()

    return rows.groupBy("security_id").applyInPandas(one, "date date, security_id long, residual double")


def audit(df: DataFrame, ret: str = "log_ret", n: int = 10, cost_bps: float = 10.0, more_than: int = 20) -> DataFrame:
    """One row of statistics of scores against same-day returns and labels: IC, ICIR, spread, its annual return, volatility, Sharpe and drawdown."""
    from rankloom.operators.metrics import daily_ic, with_buckets

    ic = daily_ic(df, more_than + 1).agg(F.avg("ic").alias("mean_ic"), (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * math.sqrt(252)).alias("icir"))
    mean = lambda b: F.avg(F.when(F.col("bucket") == b, F.col(ret)))
    days = with_buckets(df.where(F.col(ret).isNotNull()), n, more_than + 1).groupBy("date").agg((mean(n) - mean(1) - F.lit(cost_bps / 1e4)).alias("net")).where("net is not null")
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    c = days.withColumn("equity", F.product(F.col("net") + 1).over(w))
    c = c.withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    vol = F.stddev_samp("net") * math.sqrt(252)
    stats = c.agg((F.avg("net") * 252).alias("ann_return"), vol.alias("ann_vol"), F.try_divide(F.avg("net") * 252, vol).alias("sharpe"), F.min("dd").alias("max_drawdown"))
    return ic.join(F.broadcast(stats))  # one row each


def trend(series: DataFrame, value: str) -> DataFrame:
    """(slope, intercept) of the running sum of a daily series against its position."""
    w = W.orderBy("date")
    c = series.select(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("y"), (F.row_number().over(w) - 1).cast("double").alias("x"))
    return c.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def simple_returns(panel: DataFrame) -> DataFrame:
    return panel.select("date", "security_id", log1p_return(F.col("ret_total")).alias("log_ret"))
