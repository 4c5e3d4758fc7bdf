"""Ranking operators: hand-made cases, tampering with the future, and plain restatements."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import columns as c
from rankloom.operators import backtest as bt
from rankloom.operators import losses, metrics, research
from rankloom.operators.features import build_features, build_market
from rankloom.operators.labels import forward_return
from rankloom.operators import models, ranker
from rankloom.operators.models import attribution, sample_days, surrogate_fidelity
from rankloom.operators.splits import BurnInWalkForward, PurgedWalkForward, assign
from rankloom.operators.universe import slots_by_day, topk_dollar_volume
from rankloom.operators.windows import market_windows, tensors, windows
from rankloom.sources.panel import calendar, factor_csv, indexed, ticker_csv, write_ticker_csv

D = dt.date(2020, 1, 1)
day = lambda n: D + dt.timedelta(days=n)
PANEL = "security_id long, date date, close double, volume double, adj_close double, ret_total double"


def panel(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def volumes(spark, table):
    """One security per column of volumes, close 1; None is no record."""
    return panel(spark, [(s, day(n), 1.0, float(v), 1.0, 0.0) for s, vs in table.items() for n, v in enumerate(vs) if v is not None])


def chosen(df):
    out = {}
    for r in df.orderBy("refresh_date", "slot").collect():
        out.setdefault(r["refresh_date"], []).append(r["security_id"])
    return list(out.values())


ARGS = {"x": 3, "y": 3, "ttl": 3, "start": day(3), "end": day(8)}


def test_an_incumbent_inside_the_band_stays(spark):
    p = volumes(spark, {1: [9] * 9, 2: [8] * 9, 3: [7] * 3 + [8.5] * 6})
    assert chosen(topk_dollar_volume(p, k=2, buffer_ratio=0.5, **ARGS)) == [[1, 2], [1, 2]]
    assert chosen(topk_dollar_volume(p, k=2, buffer_ratio=0.0, **ARGS)) == [[1, 2], [1, 3]]


def test_an_incumbent_outside_the_band_goes_and_order_is_by_liquidity(spark):
    p = volumes(spark, {1: [9] * 9, 2: [8] * 3 + [1] * 6, 3: [7] * 3 + [20] * 6, 4: [6] * 9})
    assert chosen(topk_dollar_volume(p, k=2, buffer_ratio=0.5, **ARGS)) == [[1, 2], [3, 1]]


def test_pads_and_eligibility(spark):
    p = volumes(spark, {1: [9] * 9, 2: [None, 8, 8, 8, 8, 8, 8, None, None], 3: [1, 1] + [None] * 7})
    df = topk_dollar_volume(p, k=3, buffer_ratio=0.0, x=2, y=3, ttl=5, start=day(3), end=day(8))
    rows = df.orderBy("refresh_date", "slot").collect()
    assert [(r["security_id"], r["is_pad"]) for r in rows] == [(1, False), (2, False), (None, True), (1, False), (None, True), (None, True)]
    assert rows[0]["valid_until"] == day(8) and rows[3]["valid_until"] == day(9)


def test_the_refresh_day_itself_does_not_count(spark):
    a = volumes(spark, {1: [9] * 9, 2: [1] * 9})
    b = volumes(spark, {1: [9] * 9, 2: [1] * 3 + [1e9] + [1] * 5})
    kw = {**ARGS, "k": 1, "end": day(4)}
    assert chosen(topk_dollar_volume(a, **kw)) == chosen(topk_dollar_volume(b, **kw)) == [[1]]


def test_filter_errors(spark):
    p = volumes(spark, {1: [9] * 9})
    for kw in ({"x": 4}, {"agg": "max"}, {"start": D}):
        with pytest.raises(ValueError):
            topk_dollar_volume(p, k=1, **{**ARGS, **kw})
    with pytest.raises(NotImplementedError):
        topk_dollar_volume(p, k=1, on_delist="refill", **ARGS)


def test_slots_follow_their_period(spark):
    p = volumes(spark, {1: [9] * 9, 2: [1] * 9})
    u = topk_dollar_volume(p, k=1, **ARGS)
    got = {r["date"]: r["security_id"] for r in slots_by_day(u, calendar(p)).collect()}
    assert got == {day(n): 1 for n in range(3, 9)}


RETURNS = [None, 0.01, 0.02, -0.03, 0.04, 0.05, 0.06]


def returns(spark, rets=RETURNS, skip=()):
    return panel(spark, [(1, day(n), 1.0, 1.0, 1.0, r) for n, r in enumerate(rets) if n not in skip] + [(2, day(n), 1.0, 1.0, 1.0, 0.0) for n in range(len(rets))])


def labels(spark, p, **kw):
    return {r["date"]: r["label"] for r in forward_return(p, D, day(20), **kw).collect() if r["security_id"] == 1}


def test_labels_compound_the_days_ahead(spark):
    assert labels(spark, returns(spark), h=3)[day(2)] == pytest.approx(1.02 * 0.97 * 1.04 - 1)
    assert labels(spark, returns(spark), h=2, offset=1)[day(2)] == pytest.approx(0.97 * 1.04 - 1)


def test_labels_need_the_last_day_and_no_missing_return(spark):
    assert labels(spark, returns(spark, skip=(3,)), h=3)[day(2)] == pytest.approx(1.02 * 1.04 - 1)
    assert labels(spark, returns(spark, skip=(4,)), h=3)[day(2)] is None
    assert labels(spark, returns(spark, [None, 0.01, 0.02, None, 0.04, 0.05, 0.06]), h=3)[day(2)] is None
    assert labels(spark, returns(spark), h=3)[day(5)] is None  # beyond the calendar
    assert labels(spark, returns(spark, [None, 0.1, -1.0, 0.1, 0.1, 0.1]), h=3)[day(2)] == -1.0
    assert day(4) not in labels(spark, returns(spark, skip=(3,)), h=1)


def test_features_need_full_windows_and_do_not_see_the_future(spark):
    rng = np.random.default_rng(0)
    rows = [(s, day(n), float(rng.uniform(1, 9)), 5.0, float(rng.uniform(1, 9)), float(rng.normal(0, 0.1)) if n else None) for s in (1, 2) for n in range(12)]
    specs = [{"func": "vol", "kwargs": {"n": 4}}, {"func": "dist_sma", "kwargs": {"n": 3}}, {"func": "log_dollar_volume"}, {"func": "log_ret", "kwargs": {"clip": [-0.05, 0.05]}}, {"func": "raw", "kwargs": {"column": "volume", "alias": "units"}}]
    read = lambda r: {(x["security_id"], x["date"]): x for x in build_features(panel(spark, r), specs, dtype="double").collect()}
    a = read(rows)
    assert a[1, day(3)]["vol_4"] is None and a[1, day(1)]["dist_sma_3"] is None
    lr = [math.log1p(r[5]) for r in rows[1:5]]
    assert a[1, day(4)]["vol_4"] == pytest.approx(np.std(lr, ddof=1))
    assert a[1, day(2)]["dist_sma_3"] == pytest.approx(rows[2][4] / np.mean([r[4] for r in rows[:3]]) - 1)
    assert abs(a[1, day(5)]["log_ret"]) <= 0.05 and a[1, D]["log_ret"] is None
    b = read([r if r[1] < day(8) else (*r[:2], 99.0, 1.0, 99.0, 0.9) for r in rows])
    assert all(a[k] == b[k] for k in a if k[1] < day(8))
    with pytest.raises(ValueError):
        build_features(panel(spark, rows), [specs[0], specs[0]])


def test_market_columns(spark):
    m = build_market(returns(spark), [{"func": "equal_weight_return"}, {"func": "breadth", "kwargs": {"alias": "up"}}])
    assert m.columns == ["date", "ts__equal_weight_return", "static__up"]
    assert {r["date"]: r[1] for r in m.collect()}[day(1)] == pytest.approx(math.log(1.01) / 2)
    with pytest.raises(ValueError):
        build_market(returns(spark), [{"func": "breadth"}] * 2)


def test_clip_and_total_losses(spark):
    r = spark.createDataFrame([(None,), (-1.0,), (-2.0,), (0.5,)], "r double").select(c.log1p_return(F.col("r")).alias("a"), c.log1p_return(F.col("r"), (-0.2, 0.2)).alias("b"))
    assert [tuple(x) for x in r.collect()] == [(None, None), (None, -0.2), (None, None), (math.log(1.5), 0.2)]


# ---------------------------------------------------------------- windows

NAMES = ["a", "b"]


def cube(spark, seed=0, days=12, k=5, lookback=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(days, k, 2))
    x[rng.random(x.shape) < 0.12] = np.nan
    f = spark.createDataFrame([(s, d, *[None if math.isnan(v) else float(v) for v in x[d, s]]) for d in range(days) for s in range(k) if not (s == 3 and d == 6)], "security_id long, day_idx int, a double, b double")
    x[6, 3] = np.nan
    slots = spark.createDataFrame([(day(d), d, s, s if s < k else None) for d in range(days) for s in range(k + 1)], "date date, day_idx int, slot int, security_id long")
    return x, f, slots


def dense(df, days, k, lookback):
    out = np.full((days, k + 1, lookback, 2), np.nan)
    real = np.zeros((days, k + 1), bool)
    for r in df.collect():
        out[r["day_idx"], r["slot"], r["lag"]] = [math.nan if r[n] is None else r[n] for n in NAMES]
        real[r["day_idx"], r["slot"]] = r["real"]
    return out, real


@pytest.mark.parametrize("fill", ["zero", "ffill"])
def test_windows_match_arrays(spark, fill):
    x, f, slots = cube(spark)
    got, real = dense(windows(slots, f, NAMES, 4, 1, fill, [{"func": "cs_zscore"}, {"func": "clip", "kwargs": {"lo": -1, "hi": 1, "features": ["a"]}}]), 12, 5, 4)
    for d in range(4, 12):
        w = np.concatenate([x[d - 4 : d].transpose(1, 0, 2), np.full((1, 4, 2), np.nan)])
        mask = (np.isnan(w).any(axis=2).sum(axis=1) <= 1) & (np.arange(6) < 5)
        assert (real[d] == mask).all()
        if fill == "ffill":
            for s in range(6):
                for t in range(1, 4):
                    w[s, t] = np.where(np.isnan(w[s, t]), w[s, t - 1], w[s, t])
        m = w[mask]
        n = (~np.isnan(m)).sum(axis=0)
        with np.errstate(all="ignore"):
            z = np.where(n > 1, (w - np.nanmean(m, axis=0)) / (np.nanstd(m, axis=0, ddof=1) + 1e-8), np.nan)
        z[..., 0] = np.clip(z[..., 0], -1, 1)
        z = np.nan_to_num(z) * mask[:, None, None]
        np.testing.assert_allclose(got[d], z, atol=1e-9)


def test_rank_transform_and_masked_slots(spark):
    x, f, slots = cube(spark, 3)
    got, real = dense(windows(slots, f, NAMES, 4, 4, transforms=[{"func": "cs_rank"}], raw=True), 12, 5, 4)
    v = x[7, :5, 0]
    ok = ~np.isnan(v)
    want = np.argsort(np.argsort(np.where(ok, v, np.inf))) / (ok.sum() - 1) - 0.5
    np.testing.assert_allclose(got[8, :5, 3, 0][ok], want[ok])
    tampered = f.withColumn("a", F.when(F.col("day_idx") >= 8, 99.0).otherwise(F.col("a")))
    again, _ = dense(windows(slots, tampered, NAMES, 4, 4, transforms=[{"func": "cs_rank"}], raw=True), 12, 5, 4)
    np.testing.assert_array_equal(got[8], again[8])
    t = tensors(windows(slots, f, NAMES, 4, 4), NAMES).where("day_idx = 8 and slot = 0").first()
    assert len(t["x"]) == 4 and len(t["x"][0]) == 2


def test_market_window_lags(spark):
    m = spark.createDataFrame([(day(n), float(n), float(10 * n)) for n in range(8)], "date date, ts__x double, static__y double")
    cal = calendar(m)
    got = {(r["date"], r["lag"]): (r[2], r[3]) for r in market_windows(cal.select("date", "day_idx"), m, cal, 3).collect()}
    assert got[day(5), 0] == (2.0, 40.0) and got[day(5), 2] == (4.0, 40.0) and (day(2), 0) not in got


# ---------------------------------------------------------------- splits, metrics, losses


def test_split_gaps_and_errors():
    folds = PurgedWalkForward(3, 5, 10, 0.2).folds(1461)
    for f in folds:
        assert f.train[0] == 0 and f.val[0] - f.train[1] == 5 and f.test[0] - f.val[1] == 15
    assert folds[-1].test[1] == 1461 and all(a.test[1] == b.test[0] for a, b in zip(folds, folds[1:]))
    for args, n in (((5,), 3), ((3, 5, 500, 0.2), 600)):
        with pytest.raises(ValueError):
            PurgedWalkForward(*args).folds(n)
    with pytest.raises(ValueError):
        PurgedWalkForward(val_frac=1.0)
    b = BurnInWalkForward(2, 5, 5, 10).folds(90)[0]
    assert b.test == (20, 60) and b.train == (0, 20)


def predictions(spark, days=6, n=30, seed=0, ties=False):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for s in range(n):
            score = float(rng.normal())
            rows.append((day(d), s, round(score, 1 if ties else 9), 0.3 * score + float(rng.normal()), "fold_1" if d < 3 else "fold_2"))
    return spark.createDataFrame(rows, "date date, security_id long, score double, label double, fold string"), rows


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_daily_ic_with_ties(spark):
    df, rows = predictions(spark, ties=True)
    got = {r["date"]: r["ic"] for r in metrics.daily_ic(df).collect()}
    for d in got:
        s, y = zip(*[(r[2], r[3]) for r in rows if r[0] == d])
        assert got[d] == pytest.approx(np.corrcoef(ranks(s), ranks(y))[0, 1])
    assert metrics.daily_ic(df, 31).count() == 0
    assert metrics.daily_ic(df.withColumn("score", F.lit(1.0))).count() == 0


def test_spread_and_monotonicity(spark):
    df = spark.createDataFrame([(D, s, float(s), float(s)) for s in range(30)], "date date, security_id long, score double, label double")
    v, days = metrics.decile_spread(df, 3, 0.0, 20)
    assert v.first()[0] == pytest.approx(20.0) and days.count() == 1
    assert metrics.decile_spread(df, 3, 100.0, 20)[0].first()[0] == pytest.approx(19.99)
    assert metrics.decile_monotonicity(df, 5)[0].first()[0] == pytest.approx(1.0)
    assert metrics.icir(df)[0].first()[0] is None
    b = metrics.with_buckets(df.where("security_id < 12"), 10, 2).orderBy("security_id").select("bucket").collect()
    assert [x[0] for x in b] == [1, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]


def test_evaluation_by_fold(spark):
    df, _ = predictions(spark)
    v, days = metrics.evaluate(df.drop("label"), df.select("date", "security_id", "label"), [{"func": "mean_ic", "kwargs": {"alias": "ic"}}, {"func": "ic_hit_rate"}])
    got = {(r["fold"], r["metric"]): r["value"] for r in v.collect()}
    assert set(got) == {(f, m) for f in ("all", "fold_1", "fold_2") for m in ("ic", "ic_hit_rate")}
    assert got["all", "ic"] == pytest.approx((got["fold_1", "ic"] + got["fold_2", "ic"]) / 2)
    assert days.where("fold = 'all'").count() == 6


@pytest.mark.parametrize("target", ["raw", "zscore"])
def test_hinge_equals_all_pairs(spark, target):
    df, rows = predictions(spark, 3, 23)
    got = {r["date"]: r["loss"] for r in losses.hybrid_hinge(df, 0.5, 0.2, 0.7, target).collect()}
    for d in got:
        s, y = (np.array(v) for v in zip(*[(r[2], r[3]) for r in rows if r[0] == d]))
        y = (y - y.mean()) / (y.std(ddof=1) + 1e-8) if target == "zscore" else y
        o = np.argsort(y)
        k = max(1, int(len(y) * 0.2))
        pairs = np.maximum(0, 0.5 - (s[o[-k:]][:, None] - s[o[:k]][None, :])).mean()
        assert got[d] == pytest.approx(pairs + 0.7 * ((s - y) ** 2).mean())


def test_rank_loss_and_validation_ic(spark):
    df = spark.createDataFrame([(D, s, float(s), s**3.0) for s in range(20)], "date date, security_id long, score double, label double")
    assert losses.mean_loss(losses.neg_pearson_rank(df)).first()[0] == pytest.approx(-1.0)
    assert losses.validation_ic(df).first()[0] == pytest.approx(1.0)
    assert losses.validation_ic(df.where("false")).first()[0] == 0.0


# ---------------------------------------------------------------- research


def tau_by_hand(x, y):
    a = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(len(x)) for j in range(i)]
    top, sx, sy = sum(p * q for p, q in a), sum(p * p for p, _ in a), sum(q * q for _, q in a)
    return top / math.sqrt(sx * sy) if sx * sy else math.nan


@pytest.mark.parametrize("seed", range(8))
def test_tau_b(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 60))
    x, y = rng.integers(0, 9, n).astype(float), rng.integers(0, 5 + 20 * seed, n).astype(float)
    assert research.tau_b(x, y) == pytest.approx(tau_by_hand(x, y), nan_ok=True)


def test_principal_component_matches_dense(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 1)) @ rng.normal(size=(1, 6)) + 0.2 * rng.normal(size=(40, 6))
    gone = rng.random(m.shape) < 0.1
    df = spark.createDataFrame([(day(i), j, float(m[i, j])) for i in range(40) for j in range(6) if not gone[i, j]], "date date, security_id long, log_ret double")
    z = np.where(gone, 0, m)
    want = np.linalg.svd(z - z.mean(axis=0))[2][0]
    got = np.array([r["loading"] for r in research.market_mode(df, 15).orderBy("security_id").collect()])
    assert abs(got @ want) == pytest.approx(1.0, abs=1e-6)


def test_principal_component_with_a_small_gap(spark):
    rng = np.random.default_rng(3)
    u, v = (np.linalg.qr(rng.normal(size=(n, 60)))[0] for n in (150, 80))
    m = u @ np.diag(np.sqrt(np.linspace(1.0, 0.4, 60))) @ v.T
    df = spark.createDataFrame([(day(i), j, float(m[i, j])) for i in range(150) for j in range(80)] + [(day(0), 80, None), (None, 3, 9.0)], "date date, security_id long, log_ret double")
    _, s, w = np.linalg.svd(m - m.mean(axis=0))
    assert 1 - (s[1] / s[0]) ** 2 < 0.03
    got = {r["security_id"]: r["loading"] for r in research.market_mode(df).collect()}
    assert sorted(got) == list(range(80)) and sum(got.values()) >= 0
    g = np.array([got[j] for j in range(80)])
    assert abs(g @ w[0]) == pytest.approx(1.0, abs=1e-12) and np.abs(g - np.sign(g @ w[0]) * w[0]).max() < 1e-7
    with pytest.raises(RuntimeError, match="not converged"):
        research.market_mode(df, 1)


def test_principal_component_of_nothing(spark):
    kind = "date date, security_id long, log_ret double"
    assert research.market_mode(spark.createDataFrame([], kind)).count() == 0
    still = spark.createDataFrame([(day(i), j, 0.0) for i in range(3) for j in range(2)], kind)
    assert {tuple(r) for r in research.market_mode(still).collect()} == {(0, 0.0), (1, 0.0)}


def test_rolling_regression_matches_lstsq():
    rng = np.random.default_rng(2)
    f, r = rng.normal(0, 0.01, (60, 2)), rng.normal(0, 0.02, 60)
    got = research._ols_paths(r, f, 20, 5)
    for t in (20, 33, 54):
        x = np.column_stack([np.ones(20), f[t - 20 : t]])
        beta = np.linalg.lstsq(x, r[t - 20 : t], rcond=None)[0]
        fwd = lambda v: np.prod(1 + v[t + 1 : t + 6], axis=0) - 1  # noqa: B023, E731
        assert got[t] == pytest.approx(fwd(r) - beta @ np.r_[1, fwd(f)])
    assert np.isnan(got[:20]).all() and np.isnan(got[55:]).all() and np.isnan(research._ols_paths(r[:20], f[:20], 20, 5)).all()


def test_densify_fills_forward_only(spark):
    p = spark.createDataFrame([(1, day(1), 5.0), (1, day(3), None), (1, day(4), 7.0), (2, D, 1.0), (2, day(5), 2.0)], "security_id long, date date, close double")
    got = {(r["security_id"], r["date"]): r["close"] for r in research.densify(p, calendar(p), ["close"]).collect()}
    assert got == {(1, day(1)): 5, (1, day(3)): 5, (1, day(4)): 7, (1, day(5)): 7, (2, D): 1, (2, day(1)): 1, (2, day(3)): 1, (2, day(4)): 1, (2, day(5)): 2}
    assert {r["security_id"] for r in research.densify(p, calendar(p), ["close"], 5).collect()} == {2}


def test_backtest_and_turnover(spark):
    rng = np.random.default_rng(4)
    rows = [(day(d), s, float(rng.normal()), float(rng.normal(0, 0.02))) for d in range(40) for s in range(12)]
    df = spark.createDataFrame(rows, "date date, security_id long, score double, log_ret double")
    p = {r["date"]: r["net"] for r in bt.long_short_periods(df.drop("log_ret"), df.drop("score"), 3, 5, 10.0).collect()}
    assert sorted(p) == [day(n) for n in range(0, 35, 5)]
    ret = np.array([r[3] for r in rows]).reshape(40, 12)
    sc = np.array([r[2] for r in rows]).reshape(40, 12)
    fwd = ret[6:11].sum(axis=0)
    o = np.argsort(sc[5])
    assert p[day(5)] == pytest.approx(0.5 * (fwd[o[-3:]].mean() - fwd[o[:3]].mean()) - 0.001)
    w = lambda d: np.where(np.isin(np.arange(12), np.argsort(sc[d])[-3:]), 1 / 3, np.where(np.isin(np.arange(12), np.argsort(sc[d])[:3]), -1 / 3, 0))
    t = {r["date"]: r["turnover"] for r in bt.turnover(df, 3, 5).collect()}
    assert t[day(10)] == pytest.approx(np.abs(w(10) - w(5)).sum() / 2) and D not in t
    with pytest.raises(NotImplementedError):
        bt.Placeholder().run(df, lambda: df)
    got = [r["probability"] for r in research.probability(spark.createDataFrame([(0.0,), (1.959964,), (None,)], "stat double")).collect()]
    assert got == [0.5, pytest.approx(0.975, abs=1e-6), None] and research.expected_best(5, 0.3) > 0


def test_explanations(spark):
    rng = np.random.default_rng(5)
    rows = [(day(d), s, *map(float, rng.normal(size=2))) for d in range(8) for s in range(30)]
    df = spark.createDataFrame(rows, "date date, security_id long, a double, b double").withColumn("score", 2 * F.col("a") - F.col("b"))
    reg = spark.createDataFrame([(day(d), "High_Vol" if d < 4 else "Low_Vol") for d in range(8)], "date date, regime string")
    got = {(r["regime"], r["feature"]): r["attribution"] for r in attribution(df, ["a", "b"], [2.0, -1.0], reg).collect()}
    assert got["High_Vol", "a"] > got["High_Vol", "b"] > 0
    assert surrogate_fidelity(df, ["a", "b"], 3, 5).first()[0] > 0.8
    few = sample_days(df, 3, 5)
    assert few.count() == 15 and few.exceptAll(sample_days(df, 3, 5)).count() == 0


# ---------------------------------------------------------------- models


def model_rows(spark, days=80, names=14, seed=0):
    """(windows in long form, labels): the label follows the last value of a, relative to the day's mean."""
    rng = np.random.default_rng(seed)
    long, labels = [], []
    for d in range(days):
        x = rng.normal(size=(names, 3, 2)) + rng.normal()
        for s in range(names):
            for lag in range(3):
                long.append((day(d), d, s, 100 + s, lag, True, float(x[s, lag, 0]), float(x[s, lag, 1])))
            labels.append((day(d), 100 + s, float(x[s, 2, 0] - x[:, 2, 0].mean() + 0.1 * rng.normal())))
    w = spark.createDataFrame(long, "date date, day_idx int, slot int, security_id long, lag int, real boolean, a double, b double")
    return w, spark.createDataFrame(labels, "date date, security_id long, label double")


def test_set_scores_follow_the_order_of_names():
    rng = np.random.default_rng(1)
    p, x = ranker.start(5, 8, 3), rng.normal(size=(9, 5))
    order = rng.permutation(9)
    assert np.allclose(ranker.scores(p, x)[order], ranker.scores(p, x[order]))
    assert not np.allclose(ranker.scores(p, x)[:4], ranker.scores(p, x[:4]))  # but they do depend on who else is there


@pytest.mark.parametrize("name", ["neg_pearson_rank", "hybrid_hinge", "squared_error"])
def test_loss_values_and_slopes(spark, name):
    rng = np.random.default_rng(2)
    s, y = rng.normal(size=40), rng.normal(size=40)
    value, slope = ranker.LOSSES[name](s, y)
    steps = [(ranker.LOSSES[name](s + 1e-6 * e, y)[0] - ranker.LOSSES[name](s - 1e-6 * e, y)[0]) / 2e-6 for e in np.eye(40)]
    assert np.allclose(slope, steps, atol=1e-5)
    df = spark.createDataFrame([(day(0), i, float(a), float(b)) for i, (a, b) in enumerate(zip(s, y))], "date date, security_id long, score double, label double")
    assert value == pytest.approx(getattr(losses, name)(df).first()["loss"], abs=1e-6)
    p, x = ranker.start(3, 4, 0), rng.normal(size=(40, 3))
    _, g = ranker.slopes(p, x, lambda z: ranker.LOSSES[name](z, y))
    for k in p:
        e = np.zeros(p[k].size)
        e[0] = 1e-6
        near = [ranker.LOSSES[name](ranker.scores({**p, k: p[k] + sign * e.reshape(p[k].shape)}, x), y)[0] for sign in (1, -1)]
        assert g[k].ravel()[0] == pytest.approx((near[0] - near[1]) / 2e-6, abs=1e-4)


@pytest.mark.parametrize("search", ["val", "inner"])
def test_ridge_by_moments_equals_a_direct_fit(spark, search, tmp_path):
    w, y = model_rows(spark)
    splitter = PurgedWalkForward(2, 2, 2, 0.2)
    p, fitted = models.fit_folds(w, ["a", "b"], y, splitter, models.WindowRidge([1e-4, 10.0], search=search), models.Training(min_valid_slots=5, monitor="val_loss"))
    assert all(f["penalty"] == 1e-4 for f in fitted.folds.values())
    base = models.summaries(w, ["a", "b"]).join(y, ["date", "security_id"]).toPandas()
    days = sorted(base.date.unique())
    fold = splitter.folds(len(days))[0]
    train = base[base.date.isin(days[slice(*fold.train)])]
    x = np.column_stack([np.ones(len(train)), train[fitted.inputs]])
    direct = np.linalg.solve(x.T @ x / len(x) + np.diag([0, *[1e-4] * 6]), x.T @ train.label / len(x))
    assert np.allclose(fitted.folds["fold_1"]["weights"], direct)
    fitted.save(spark, str(tmp_path / "m"))
    again = models.Fitted.load(spark, str(tmp_path / "m"))
    rows = models.summaries(w, ["a", "b"])
    key = lambda f: sorted(map(str, f.score(rows, "fold_2").collect()))
    assert key(again) == key(fitted) and p.groupBy("fold").count().count() == 2


def test_the_set_ranker_learns_stops_and_is_saved(spark, tmp_path):
    w, y = model_rows(spark)
    t = models.Training(loss="neg_pearson_rank", lr=0.01, batch_dates=4, max_epochs=12, early_stopping_patience=4, min_valid_slots=5, shards=2)
    fit = lambda m, t=t: models.fit_folds(w, ["a", "b"], y, PurgedWalkForward(2, 2, 2, 0.2), m, t)
    p, fitted = fit(models.SetRanker([4, 16]))
    ic = losses.validation_ic(p.join(y, ["date", "security_id"])).first()[0]
    assert ic > 0.6 and fitted.training["seed"] == 42 and min(fitted.training["monitored"].values()) > 0.6
    key = lambda df: sorted((r["date"], r["security_id"], round(r["score"], 9)) for r in df.collect())
    assert key(fit(models.SetRanker([4, 16]))[0]) == key(p)  # the same seed, the same model
    fitted.save(spark, str(tmp_path / "m"))
    rows = models.summaries(w, ["a", "b"])
    assert key(models.Fitted.load(spark, str(tmp_path / "m")).score(rows)) == key(fitted.score(rows))
    reg = spark.createDataFrame([(day(d), "High_Vol" if d % 2 else "Low_Vol") for d in range(80)], "date date, regime string")
    part = {(r["regime"], r["feature"]): r["attribution"] for r in models.set_attribution(fitted, rows.withColumn("fold", F.lit("fold_2")), reg).collect()}
    assert max(part, key=part.get)[1] == "a__last"
    with pytest.raises(ValueError, match="can't be trained by"):
        models.fit_folds(w, ["a", "b"], y, PurgedWalkForward(2, 2, 2, 0.2), models.WindowRidge(), models.Training(loss="hybrid_hinge"))


def test_fold_assignment(spark):
    df = spark.createDataFrame([(day(n),) for n in range(60)] * 2, "date date")
    got = assign(df, PurgedWalkForward(2, 2, 2, 0.2)).groupBy("fold", "segment").count().collect()
    assert {(r[0], r[1]): r[2] for r in got}["fold_2", "test"] == 20


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 200, 1000])
def test_swaps_by_counting(n):
    x = np.random.default_rng(n).integers(0, 50, n).astype(float)
    assert research._swaps(x) == sum(int((x[:i] > x[i]).sum()) for i in range(n))


def test_names_are_numbered_in_order(spark):
    names = [f"N{i:04d}" for i in np.random.default_rng(0).permutation(500)]
    got = research.stock_ids(spark.createDataFrame([(n,) for n in names + names[:50]] + [(None,)], "ticker string"), "ticker").collect()
    assert {r["ticker"]: r["stock_id"] for r in got} == {n: i for i, n in enumerate(sorted(names))} and len(got) == 500
    assert research.stock_ids(spark.createDataFrame([], "ticker string"), "ticker").count() == 0


def test_csv_sources(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date, Open ,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\nnonsense,x,y,z,q,r\n2020-01-03,,,,,\n")
    (tmp_path / "B.C.csv").write_text(" Close,VOLUME, note,date,open,high,low\n1.5,100,x,2020-01-02,1,2,0.5\n")
    (tmp_path / "empty.csv").write_text("")
    got = sorted((r["ticker"], r["date"], r["close"], r["volume"], r["open"]) for r in ticker_csv(spark, str(tmp_path)).collect())
    assert got == [("AAA", dt.date(2020, 1, 2), 1.5, 100.0, 1.0), ("B-C", dt.date(2020, 1, 2), 1.5, 100.0, 1.0)]
    write_ticker_csv(ticker_csv(spark, str(tmp_path)), str(tmp_path / "out" / "bars"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "bars")).count() == 2
    f = tmp_path / "f"
    f.mkdir()
    (f / "factors.csv").write_text("when,Mkt-RF,SMB\n20200102,1.5,-2\nCopyright,,\n")
    assert [tuple(r) for r in factor_csv(spark, str(f)).collect()] == [(dt.date(2020, 1, 2), 0.015, -0.02)]


def test_indexed_calendar(spark):
    p = returns(spark, skip=(3,))
    assert indexed(p).where("security_id = 1").orderBy("date").select("day_idx").collect()[3][0] == 4
