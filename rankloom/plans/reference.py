"""Queries for the ranking operators, on weekly bars made from the order lines.

Each takes (spark, folder of the tables) and runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.columns import rounded
from rankloom.operators import backtest as bt
from rankloom.operators import features as ft
from rankloom.operators import losses as ls
from rankloom.operators import metrics as mt
from rankloom.operators import research as rs
from rankloom.operators import splits as sp
from rankloom.operators.labels import forward_return
from rankloom.operators.universe import slots_by_day, topk_dollar_volume
from rankloom.operators.windows import market_windows, tensors, windows
from rankloom.sources.files import Files
from rankloom.sources.panel import calendar, indexed, lineitem_weekly

START, END = "1995-07-03", "2001-10-29"
N = 8
TOPK = {"k": 30, "buffer_ratio": 0.1, "x": 8, "y": 12, "ttl": 4}
LOOKBACK, MISSING = 10, 3
MIN_STOCKS = 5
SPLIT = {"n_folds": 4, "purge": 5, "embargo": 5, "val_frac": 0.2}
FEATURES = [{"func": "log_ret"}, {"func": "dist_sma", "kwargs": {"n": N}}]
NAMES = ["log_ret", f"dist_sma_{N}"]
INDICATORS = [{"func": "equal_weight_return"}, {"func": "breadth"}, {"func": "equal_weight_return", "kwargs": {"alias": "again"}}]
BUCKETS, HOLD, FREQ, COST = 5, 10, 5, 10.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


_kept: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def release() -> None:
    """Give up all tables that queries share."""
    while _kept:
        _kept.popitem()[1][1].unpersist()


def kept(name: str, make: Query) -> Query:
    """A table that many queries share (a pipeline would have stored it): made on first use, then held in memory or on disk until the order lines' files change."""

    def get(spark: SparkSession, sf: str) -> DataFrame:
        key, state = (spark.sparkContext.applicationId, sf, name), str(Files(spark).stamp(f"{sf}/lineitem.parquet"))
        old = _kept.get(key)
        if old is None or old[0] != state:
            if old is not None:
                old[1].unpersist()
            _kept[key] = (state, make(spark, sf).persist(StorageLevel.MEMORY_AND_DISK))
        return _kept[key][1]

    return get


# the bars stay partitioned and ordered by security, so windows over them need no shuffle
panel = kept("panel", lambda spark, sf: lineitem_weekly(spark, f"{sf}/lineitem.parquet"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


@query
def panel_weekly(spark, sf):
    return _round(panel(spark, sf))


@query
def panel_between(spark, sf):
    """The scan between two days, inclusive."""
    return _round(lineitem_weekly(spark, f"{sf}/lineitem.parquet", "1997-01-06", "1997-12-29").select("security_id", "date", "close"))


@query
def calendar_days(spark, sf):
    return _round(calendar(panel(spark, sf)))


def _feature(spark, sf, spec):
    return _round(ft.build_features(panel(spark, sf), [spec], dtype="double"))


@query
def feat_log_ret(spark, sf):
    return _feature(spark, sf, {"func": "log_ret"})


@query
def feat_log_ret_clip(spark, sf):
    return _feature(spark, sf, {"func": "log_ret", "kwargs": {"clip": [-0.2, 0.2]}})


@query
def feat_vol(spark, sf):
    return _feature(spark, sf, {"func": "vol", "kwargs": {"n": N}})


@query
def feat_dist_sma(spark, sf):
    return _feature(spark, sf, {"func": "dist_sma", "kwargs": {"n": N}})


@query
def feat_log_dollar_volume(spark, sf):
    return _feature(spark, sf, {"func": "log_dollar_volume"})


@query
def feat_log_dollar_volume_n(spark, sf):
    return _feature(spark, sf, {"func": "log_dollar_volume", "kwargs": {"n": 4}})


@query
def feat_raw(spark, sf):
    return _feature(spark, sf, {"func": "raw", "kwargs": {"column": "volume", "alias": "units"}})


@query
def ind_equal_weight_return(spark, sf):
    return _round(panel(spark, sf).groupBy("date").agg(ft.equal_weight_return().alias("value")))


@query
def market_table(spark, sf):
    return _round(ft.build_market(panel(spark, sf), INDICATORS))


def _universe(spark, sf, agg="sum"):
    return kept(f"universe {agg}", lambda spark, sf: topk_dollar_volume(panel(spark, sf), START, END, agg=agg, **TOPK))(spark, sf)


@query
def universe_topk(spark, sf):
    return _round(_universe(spark, sf))


@query
def universe_topk_mean(spark, sf):
    return _round(_universe(spark, sf, "mean"))


@query
def universe_topk_median(spark, sf):
    return _round(_universe(spark, sf, "median"))


@query
def slots_per_day(spark, sf):
    return _round(slots_by_day(_universe(spark, sf), calendar(panel(spark, sf))))


@query
def label_forward_return(spark, sf):
    return _round(forward_return(panel(spark, sf), START, END))


@query
def label_offset1(spark, sf):
    return _round(forward_return(panel(spark, sf), START, END, h=3, offset=1))


def _windows(spark, sf, **kw):
    p = panel(spark, sf)
    cal = calendar(p)
    f = indexed(ft.build_features(p, FEATURES, dtype="double"), cal)
    return windows(slots_by_day(_universe(spark, sf), cal), f, NAMES, LOOKBACK, MISSING, **kw)


def _long(df):
    return _round(df.select("date", "slot", "lag", "real", *NAMES))


@query
def window_mask(spark, sf):
    return _round(_windows(spark, sf).select("date", "slot", "security_id", "real").distinct())


@query
def window_zero(spark, sf):
    return _long(_windows(spark, sf))


@query
def window_ffill(spark, sf):
    return _long(_windows(spark, sf, fill="ffill"))


@query
def xf_zscore(spark, sf):
    return _long(_windows(spark, sf, transforms=[{"func": "cs_zscore"}]))


@query
def xf_zscore_population(spark, sf):
    return _long(_windows(spark, sf, transforms=[{"func": "cs_zscore", "kwargs": {"ddof": 0}}]))


@query
def window_tensor(spark, sf):
    """The windows as nested arrays, taken apart again by place."""
    x = tensors(_windows(spark, sf), NAMES, LOOKBACK).select("date", "slot", F.posexplode("x").alias("lag", "v"))
    return _round(x.select("date", "slot", "lag", F.posexplode("v").alias("feature", "v")).withColumn("v", F.round(F.col("v").cast("double"), 4)))


@query
def xf_clip(spark, sf):
    return _long(_windows(spark, sf, transforms=[{"func": "cs_zscore"}, {"func": "clip", "kwargs": {"lo": -1.5, "hi": 1.5, "features": ["log_ret"]}}]))


@query
def xf_rank(spark, sf):
    return _long(_windows(spark, sf, transforms=[{"func": "cs_rank"}]))


@query
def window_market(spark, sf):
    p = panel(spark, sf)
    cal = calendar(p)
    return _round(market_windows(slots_by_day(_universe(spark, sf), cal), ft.build_market(p, INDICATORS[:2]), cal, LOOKBACK))


def _predictions(spark, sf):
    """(date, security_id, score, label): the score is the distance from the average on the day before, turned around."""
    p = panel(spark, sf)
    cal = calendar(p)
    f = indexed(ft.build_features(p, [FEATURES[1]], dtype="double"), cal).select("security_id", (F.col("day_idx") + 1).alias("day_idx"), F.round(-F.col(NAMES[1]), 9).alias("score")).where("score is not null")
    return f.join(F.broadcast(cal), "day_idx").select("date", "security_id", "score").join(forward_return(p, START, END), ["date", "security_id"]).withColumn("label", F.round("label", 9))


predictions = kept("predictions", _predictions)


def _folds(spark, sf):
    p = predictions(spark, sf)
    test = sp.assign(p, sp.PurgedWalkForward(**SPLIT)).where("segment = 'test'").select("date", "fold")
    return p.join(F.broadcast(test), "date")


@query
def split_purged(spark, sf):
    return _round(sp.fold_table(spark, sp.PurgedWalkForward(**SPLIT).folds(calendar(panel(spark, sf)).count())))


@query
def split_burn_in(spark, sf):
    """The splits without validation part, tests with the windows' days before them."""
    folds = sp.BurnInWalkForward(SPLIT["n_folds"], SPLIT["purge"], SPLIT["embargo"], LOOKBACK - 1).folds(calendar(panel(spark, sf)).count())
    return _round(sp.fold_table(spark, folds))


@query
def metric_ic_by_date(spark, sf):
    return _round(mt.daily_ic(predictions(spark, sf), MIN_STOCKS))


@query
def metric_mean_ic(spark, sf):
    return _round(mt.mean_ic(predictions(spark, sf), MIN_STOCKS)[0])


@query
def metric_icir(spark, sf):
    return _round(mt.icir(predictions(spark, sf), MIN_STOCKS, periods_per_year=52.0)[0])


@query
def metric_hit_rate(spark, sf):
    return _round(mt.ic_hit_rate(predictions(spark, sf), MIN_STOCKS)[0])


@query
def metric_decile_spread(spark, sf):
    return _round(mt.decile_spread(predictions(spark, sf), BUCKETS, 10.0, MIN_STOCKS)[1])


@query
def metric_bucket_profile(spark, sf):
    return _round(mt.bucket_profile(predictions(spark, sf), BUCKETS, MIN_STOCKS))


@query
def metric_bucket_pooled(spark, sf):
    """Mean label per bucket over all rows."""
    return _round(mt.with_buckets(predictions(spark, sf), BUCKETS, MIN_STOCKS).groupBy("bucket").agg(F.avg("label").alias("label")))


@query
def metric_decile_monotonicity(spark, sf):
    return _round(mt.decile_monotonicity(predictions(spark, sf), BUCKETS, MIN_STOCKS)[0])


@query
def metrics_by_fold(spark, sf):
    p = _folds(spark, sf)
    specs = [{"func": "mean_ic", "kwargs": {"min_stocks": MIN_STOCKS}}, {"func": "ic_hit_rate", "kwargs": {"min_stocks": MIN_STOCKS}}, {"func": "decile_spread", "kwargs": {"n": BUCKETS, "min_stocks": MIN_STOCKS}}]
    return _round(mt.evaluate(p.drop("label"), p.select("date", "security_id", "label"), specs)[0])


@query
def loss_hinge(spark, sf):
    return _round(ls.hybrid_hinge(predictions(spark, sf)))


@query
def loss_pearson_rank(spark, sf):
    return _round(ls.neg_pearson_rank(predictions(spark, sf)))


@query
def validation_ic(spark, sf):
    return _round(ls.validation_ic(predictions(spark, sf)))


def _returns(spark, sf):
    return rs.simple_returns(panel(spark, sf))


def _periods(spark, sf):
    return bt.long_short_periods(predictions(spark, sf), _returns(spark, sf), HOLD, FREQ, COST)


@query
def bt_long_short(spark, sf):
    return _round(_periods(spark, sf))


@query
def bt_drawdown(spark, sf):
    return _round(bt.curve(_periods(spark, sf), FREQ))


@query
def bt_summary(spark, sf):
    return _round(bt.summary(_periods(spark, sf), FREQ))


@query
def bt_turnover(spark, sf):
    return _round(bt.turnover(predictions(spark, sf), HOLD, FREQ))


@query
def bt_top_beats_bottom(spark, sf):
    return _round(bt.top_beats_bottom(predictions(spark, sf), BUCKETS, FREQ, MIN_STOCKS))


@query
def kendall_ic(spark, sf):
    return _round(rs.daily_tau(predictions(spark, sf), MIN_STOCKS))


@query
def kendall_summary(spark, sf):
    return _round(rs.kendall_summary(rs.daily_tau(predictions(spark, sf), MIN_STOCKS)))


@query
def alpha_decay(spark, sf):
    return _round(rs.alpha_decay(predictions(spark, sf), range(1, 6), MIN_STOCKS))


@query
def horizon_retention(spark, sf):
    return _round(rs.horizon_retention(predictions(spark, sf), _returns(spark, sf), min_stocks=MIN_STOCKS))


@query
def newey_west(spark, sf):
    return _round(rs.newey_west(mt.daily_ic(predictions(spark, sf), MIN_STOCKS), "ic"))


@query
def deflated_sharpe(spark, sf):
    return _round(rs.deflated_sharpe(_periods(spark, sf), "gross", 5, 0.3, FREQ))


@query
def deflated_probability(spark, sf):
    """The statistic and the probability that it stands for, against few trials of little spread."""
    return _round(rs.probability(rs.deflated_sharpe(_periods(spark, sf), "gross", 3, 0.01, FREQ)).select("stat", "probability"))


@query
def ic_trend(spark, sf):
    return _round(rs.trend(mt.daily_ic(predictions(spark, sf), MIN_STOCKS), "ic"))


@query
def audit(spark, sf):
    p = predictions(spark, sf).join(_returns(spark, sf), ["date", "security_id"])
    return _round(rs.audit(p, n=BUCKETS, more_than=MIN_STOCKS - 1))


def _legacy(spark, sf):
    return rs.legacy_features(panel(spark, sf), vol_n=12, short=4, long=12)


@query
def legacy_features(spark, sf):
    return _round(_legacy(spark, sf))


@query
def legacy_zscores(spark, sf):
    return _round(rs.day_zscores(_legacy(spark, sf), ["log_ret", "vol", "dsma_short", "dsma_long"]))


@query
def vol_factor_quintile(spark, sf):
    return _round(rs.volatility_factor(_legacy(spark, sf), "vol"))


@query
def regime_flags(spark, sf):
    return _round(rs.volatility_regimes(_legacy(spark, sf), "vol", 12))


@query
def densify_ffill(spark, sf):
    p = panel(spark, sf)
    return _round(rs.densify(p, calendar(p), ["close", "volume"]))


@query
def strict_intersection(spark, sf):
    return _round(rs.strict_intersection(panel(spark, sf).select("date", "security_id", "close")))


@query
def dictionary_ids(spark, sf):
    return _round(rs.stock_ids(spark.read.parquet(f"{sf}/residualizer.parquet"), "ticker"))


@query
def neutral_scores(spark, sf):
    """Scores without what a known loading (the name's mean return) explains."""
    loading = _returns(spark, sf).groupBy("security_id").agg(F.avg("log_ret").alias("loading"))
    return _round(rs.neutral_scores(predictions(spark, sf), loading))


@query
def neutral_deciles(spark, sf):
    """Bucket profile of scores without the market's first principal component."""
    return _round(mt.bucket_profile(rs.neutral_scores(predictions(spark, sf), rs.market_mode(_returns(spark, sf))), BUCKETS, MIN_STOCKS))


def _with_market(spark, sf):
    p = panel(spark, sf)
    m = p.groupBy("date").agg(ft.equal_weight_return().alias("mkt"))
    return rs.simple_returns(p).where("log_ret is not null").join(F.broadcast(m), "date")


@query
def rolling_ols_residual(spark, sf):
    return _round(rs.rolling_ols_residual(_with_market(spark, sf), "log_ret", ["mkt"], 26, 5))


@query
def rolling_ols_two_factors(spark, sf):
    f = rs.volatility_factor(_legacy(spark, sf), "vol").where("factor is not null")
    return _round(rs.rolling_ols_residual(_with_market(spark, sf).join(F.broadcast(f), "date"), "log_ret", ["mkt", "factor"], 26, 5))


@query
def quantile_deciles(spark, sf):
    return _round(mt.quantile_buckets(predictions(spark, sf), BUCKETS).select("date", "security_id", "bucket"))


@query
def ic_rolling(spark, sf):
    return _round(mt.rolling_mean(mt.daily_ic(predictions(spark, sf), MIN_STOCKS), "ic"))


@query
def bucket_columns(spark, sf):
    return _round(mt.bucket_columns(predictions(spark, sf), BUCKETS, MIN_STOCKS))


@query
def kendall_monotonicity(spark, sf):
    p = mt.bucket_profile(predictions(spark, sf), BUCKETS, MIN_STOCKS)
    one = p.select(F.lit("1970-01-01").cast("date").alias("date"), F.col("bucket").alias("score"), "label")
    return _round(rs.daily_tau(one, 2).select(F.col("tau").alias("value")))


@query
def turnover_annual(spark, sf):
    return _round(bt.annual(bt.turnover(predictions(spark, sf), HOLD, FREQ), "turnover", FREQ))


@query
def decision_days(spark, sf):
    """Days that a period covers and that have a whole window before them."""
    s = slots_by_day(_universe(spark, sf), calendar(panel(spark, sf)))
    return _round(s.where(F.col("day_idx") >= LOOKBACK).select("date", "day_idx").distinct())


@query
def labelled_days(spark, sf):
    """Decision days with enough labelled slots."""
    p = panel(spark, sf)
    s = slots_by_day(_universe(spark, sf), calendar(p)).where("not is_pad").join(forward_return(p, START, END), ["date", "security_id"])
    return _round(s.groupBy("date").agg(F.count("label").alias("n")).where("n >= 20"))


@query
def scored_returns(spark, sf):
    """Returns of the scored names alone, from the first scored day on."""
    p = predictions(spark, sf)
    first = p.agg(F.min("date").alias("first"))
    r = _returns(spark, sf).join(p.select("security_id").distinct(), "security_id", "left_semi").join(F.broadcast(first))
    return _round(r.where("date >= first").select("date", "security_id", "log_ret"))


@query
def regime_attribution(spark, sf):
    """What each input of a linear score contributes in quiet and in volatile days."""
    from rankloom.operators.models import attribution

    z = rs.day_zscores(_legacy(spark, sf), ["log_ret", "vol", "dsma_short"])
    return _round(attribution(z, ["log_ret", "vol", "dsma_short"], [0.5, -0.2, -0.3], rs.volatility_regimes(_legacy(spark, sf), "vol", 12)))


@query
def series_alignment(spark, sf):
    """Per-date metric series side by side: a full outer join on the date."""
    a = mt.daily_ic(predictions(spark, sf), MIN_STOCKS)
    b = mt.decile_spread(predictions(spark, sf), BUCKETS, 0.0, MIN_STOCKS)[1]
    return _round(a.join(b, "date", "full"))


def _fitted(spark, sf, model, **training):
    from rankloom.operators.models import Training, fit_folds

    w = _windows(spark, sf, transforms=[{"func": "cs_zscore"}, {"func": "clip"}])
    return fit_folds(w, NAMES, forward_return(panel(spark, sf), START, END), sp.PurgedWalkForward(**SPLIT), model, Training(min_valid_slots=MIN_STOCKS, **training))


@query
def model_walk_forward(spark, sf):
    """Out-of-sample scores of a linear ranking model under the purged walk-forward splits."""
    from rankloom.operators.models import WindowRidge

    return _round(_fitted(spark, sf, WindowRidge())[0])


@query
def model_test_rows(spark, sf):
    """Which names the model scores on which test days of which fold."""
    from rankloom.operators.models import WindowRidge

    return _round(_fitted(spark, sf, WindowRidge())[0].where("score is not null").select("date", "slot", "security_id", "fold"))


@query
def model_inner_search(spark, sf):
    """The same with the penalty chosen by a purged split of the training days alone."""
    from rankloom.operators.models import WindowRidge

    return _round(_fitted(spark, sf, WindowRidge([0.001, 0.1, 10.0], search="inner"))[0])


@query
def ranker_walk_forward(spark, sf):
    """Out-of-sample scores of the set ranker, trained by the rank correlation."""
    from rankloom.operators.models import SetRanker

    return _round(_fitted(spark, sf, SetRanker(8), loss="neg_pearson_rank", max_epochs=3, lr=0.01)[0])


@query
def ranker_invariance(spark, sf):
    """(change, largest_difference): what becomes of the scores when slots are shuffled, and when pads hold other values."""
    from rankloom.operators.models import SetRanker, summaries

    fitted = _fitted(spark, sf, SetRanker(8), loss="neg_pearson_rank", max_epochs=1, lr=0.01)[1]
    long = _windows(spark, sf, transforms=[{"func": "cs_zscore"}, {"func": "clip"}])
    score = lambda df: fitted.score(summaries(df, NAMES)).select("date", "security_id", "score")
    shuffled = long.withColumn("slot", F.pmod(F.xxhash64("date", "security_id"), F.lit(1 << 30)).cast("int"))
    filled = long.withColumns({n: F.when(F.col("real"), F.col(n)).otherwise(F.lit(9.0)) for n in NAMES})
    base, out = score(long).withColumnRenamed("score", "base"), None
    for name, other in (("pads", filled), ("slots", shuffled)):
        d = base.join(score(other), ["date", "security_id"], "full").agg(F.max(F.coalesce(F.abs(F.col("base") - F.col("score")), F.lit(9.0))).alias("largest_difference")).select(F.lit(name).alias("change"), "largest_difference")
        out = d if out is None else out.unionByName(d)
    return _round(out)
