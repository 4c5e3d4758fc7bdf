"""The general data problems: each operator against a plain restatement, and its defined edge cases."""

import datetime as dt
import math
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import asof, intervals, rolling, spikes
from rankloom.operators.impute import Mixture, Number, Word, fit_mixture, impute
from rankloom.operators.regrid import regrid

D = dt.date(2020, 1, 6)  # a Monday
day = lambda n: D + dt.timedelta(days=n)


# ---------------------------------------------------------------- spikes


def series(n=120, seed=0, sd=0.01):
    r = np.random.default_rng(seed).normal(0, sd, n)
    x = 50 * np.exp(np.cumsum(r))
    r[0] = np.nan
    return x, r


def flags(x, r, v=None):
    return spikes.detect(np.zeros(len(x), int), x, r, np.ones(len(x)) if v is None else v)


def test_a_spike_and_a_patch_are_found_and_nothing_else():
    x, r = series()
    x = x.copy()
    x[40] *= 1.3
    x[70:72] *= 0.7
    f = flags(x, r)
    assert np.flatnonzero(f["spike_value"]).tolist() == [40, 70, 71]
    assert not f["spike_return"].any()


def test_returns_that_lead_to_and_back_from_a_spike():
    x, r = series()
    x, r = x.copy(), r.copy()
    x[40] *= 1.3
    r[40] += math.log(1.3)
    r[41] -= math.log(1.3)
    f = flags(x, r)
    assert np.flatnonzero(f["spike_value"]).tolist() == [40]
    assert np.flatnonzero(f["spike_return"]).tolist() == [40, 41]


def test_a_lasting_move_is_honest_and_a_lone_return_is_not():
    x, r = series()
    x, r = x.copy(), r.copy()
    x[60:] *= 1.5
    r[60] += math.log(1.5)
    r[90] = 0.4
    f = flags(x, r)
    assert not f["spike_value"].any()
    assert np.flatnonzero(f["spike_return"]).tolist() == [90]


@pytest.mark.parametrize("at", [0, 119])
def test_a_spike_at_either_end_is_told_by_the_return(at):
    x, r = series()
    x = x.copy()
    x[at] *= 2
    assert np.flatnonzero(flags(x, r)["spike_value"]).tolist() == [at]


def test_stuck_runs_need_six_traded_repeats():
    x, r = series()
    x, v = x.copy(), np.ones(120)
    x[20:27] = x[20]
    x[50:56] = x[50]  # five repeats only
    x[80:90] = x[80]
    v[80:90] = 0  # carried without trade
    assert np.flatnonzero(flags(x, r, v)["stuck_value"]).tolist() == list(range(21, 27))


def test_impossible_values_and_missing_ones():
    x, r = series()
    x, r = x.copy(), r.copy()
    x[[10, 11, 12]] = [-3, np.inf, np.nan]
    r[[30, 31]] = [-999, np.nan]
    assert np.flatnonzero(flags(x, r)["impossible"]).tolist() == [10, 11, 30]


def bars(spark, rows):
    return spark.createDataFrame(rows, "bar_id long, ticker string, date timestamp_ntz, close double, log_ret double, volume double, k int, d int, row string")


def test_bars_repeated_null_and_empty(spark):
    x, r = series()
    x = x.copy()
    x[40] *= 1.4
    at = lambda n: dt.datetime.combine(day(n), dt.time())
    rows = [(i, "A", at(i), float(x[i]), None if i == 0 else float(r[i]), 5.0, 1, 2, "z") for i in range(120)]
    rows += [(1040, "A", at(40), float(x[40]), float(r[40]), 5.0, None, None, None), (2000, None, at(3), 1.0, 1.0, 1.0, 0, 0, ""), (2001, "B", None, -1.0, 1.0, 1.0, 0, 0, ""), (2002, "C", at(1), None, None, None, 0, 0, ""), (2003, "C", at(2), -5.0, None, None, 0, 0, "")]
    got = {x[0] for x in spikes.implausible(bars(spark, rows), "bar_id", "ticker", "date", "close", "log_ret", "volume").select("bar_id").collect()}
    assert got == {40, 1040, 2003}
    assert spikes.implausible(bars(spark, []), "bar_id", "ticker", "date", "close", "log_ret", "volume").count() == 0


def test_every_reading_of_a_day_is_tested(spark):
    x, r = series()
    at = lambda n: dt.datetime.combine(day(n), dt.time())
    bar = lambda i, n, close, ret=None: (i, "A", at(n), close, float(r[n]) if ret is None else ret, 5.0, 1, 2, "z")
    rows = [bar(i, i, float(x[i]) * (1.4 if i == 70 else 1)) for i in range(1, 120)]
    # later rows of a day: an impossible value, a spike, a return of no use, the same again, an honest one beside a spike
    rows += [bar(1040, 40, -1.0), bar(1050, 50, float(x[50]) * 1.4), bar(1060, 60, float(x[60]), 50.0), bar(1061, 61, float(x[61])), bar(1070, 70, float(x[70])), bar(1071, 70, float(x[70]) * 1.4)]
    got = sorted(x[0] for x in spikes.implausible(bars(spark, rows), "bar_id", "ticker", "date", "close", "log_ret", "volume").select("bar_id").collect())
    assert got == [70, 1040, 1050, 1060, 1071]
    days = spikes.implausible_days(bars(spark, rows), "ticker", "date", "close", "log_ret", "volume", "bar_id")
    assert sorted(r["date"] for r in days.collect()) == [day(n) for n in (40, 50, 60, 70)]


def changing(seed):
    """3,000 days whose spread changes fivefold halfway, with spikes that only the quiet half would call large."""
    rng = np.random.default_rng(seed)
    r = rng.normal(0, 1, 3000) * np.where(np.arange(3000) < 1500, 0.01, 0.05)
    x = 100 * np.exp(np.cumsum(r))
    x[[300, 700, 1100]] *= math.exp(0.25)
    x[[500, 1900]] *= math.exp(0.9)
    return x, r


@pytest.mark.parametrize("offset", [0, 217, 1023])
def test_a_series_is_never_cut(spark, offset):
    at = lambda n: dt.datetime.combine(day(n + offset), dt.time())
    rows, wanted = [], set()
    for k in range(2):
        x, r = changing(k)
        f = flags(x, r)
        hit = np.logical_or.reduce([f[c] for c in spikes.REASONS])
        wanted |= {k * 10000 + int(i) for i in np.flatnonzero(hit)}
        rows += [(k * 10000 + i, f"T{k}", at(i), float(x[i]), float(r[i]), 5.0, 1, 2, "z") for i in range(3000)]
    got = {x[0] for x in spikes.implausible(bars(spark, rows), "bar_id", "ticker", "date", "close", "log_ret", "volume").select("bar_id").collect()}
    assert got == wanted
    assert {500, 1900, 10500, 11900} <= got and not got & {300, 700, 1100}


WORKER = """
import sys
import pyarrow as pa
from rankloom.operators import spikes
spikes.SHARD_ROWS = 500
out = list(spikes._work(pa.ipc.open_stream(sys.stdin.buffer), {}))
with pa.ipc.new_stream(sys.stdout.buffer, out[0].schema) as w:
    for b in out:
        w.write_batch(b)
"""


def test_full_shards_in_a_worker_that_did_nothing_before():
    """As a Spark worker does, it reads Arrow batches and has loaded nothing else; series go on over batches, one is longer than a shard."""
    parts, wanted = [], set()
    for j, (k, n) in enumerate({"A": 300, "B": 1500, "C": 199, "D": 301, "E": 700}.items()):
        x, r = series(n, j)
        x = x.copy()
        x[[20, n // 2, n - 20]] *= 1.3
        f = flags(x, r)
        hit = np.flatnonzero(np.logical_or.reduce([f[c] for c in spikes.REASONS]))
        assert {20, n // 2, n - 20} <= set(hit.tolist())
        wanted |= {(k, int(i)) for i in hit}
        parts.append(pa.table({"k": [k] * n, "d": pa.array(range(n), pa.int32()), "value": x, "ret": r, "volume": np.ones(n), "more": np.zeros(n, bool)}))
    t = pa.concat_tables(parts).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        for b in t.to_batches(max_chunksize=250):
            w.write_batch(b)
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", WORKER], input=sink.getvalue().to_pybytes(), capture_output=True, env=env, timeout=120)
    assert done.returncode == 0, done.stderr.decode()
    out = list(pa.ipc.open_stream(done.stdout))
    assert len(out) > 2
    got = [(k, d) for b in out for k, d in zip(b["k"].to_pylist(), b["d"].to_pylist(), strict=True)]
    assert sorted(got) == sorted(wanted)


def test_outlier_and_shift_are_held_against_each_other():
    x, r = series()
    up = lambda *at: np.exp(0.5 * np.isin(np.arange(120), at))
    patch = flags(x * up(40, 41, 42), r)
    assert np.flatnonzero(patch["spike_value"]).tolist() == [40, 41, 42]
    stays = flags(x * np.exp(0.5 * (np.arange(120) >= 40)), r)
    assert not stays["spike_value"].any()
    # a shift and, while it lasts, a spike of its own; then five readings off, which is two shifts
    both = flags(x * np.exp(0.5 * (np.arange(120) >= 40)) * np.exp(-0.6 * (np.arange(120) == 43)), r)
    assert np.flatnonzero(both["spike_value"]).tolist() == [43]
    assert not flags(x * up(*range(60, 65)), r)["spike_value"].any()
    for apart in (2, 3, 4, 5):  # two spikes are not the ordinary readings between them
        assert np.flatnonzero(flags(x * up(50, 50 + apart), r)["spike_value"]).tolist() == [50, 50 + apart]
    uneven = flags(x * np.exp(0.5 * (np.arange(120) == 70) + 1.9 * (np.arange(120) == 71)), r)
    assert np.flatnonzero(uneven["spike_value"]).tolist() == [70, 71]


# ---------------------------------------------------------------- rolling


def readings(spark, rows):
    return spark.createDataFrame(rows, "security_id long, date date, v double, k string, n int, s double")


def rolling_by_hand(rows, periods=(7, 30)):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        mine = [(d, v) for e, d, v, *_ in rows if e == k and d is not None]
        if not mine:
            continue
        d, last = min(x for x, _ in mine), max(x for x, _ in mine)
        while d <= last:
            line = []
            for p in periods:
                inside = [v for x, v in mine if d - dt.timedelta(days=p) < x <= d]
                ok = [v for v in inside if v is not None and math.isfinite(v)]
                line += [len(inside), round(sum(ok), 9) + 0.0, round(sum(ok) / len(ok), 9) + 0.0 if ok else None]
            out[k, d] = line
            d += dt.timedelta(days=1)
    return out


def as_lines(df):
    return {(r[0], r[1]): [round(x, 9) + 0.0 if isinstance(x, float) else x for x in r[2:]] for r in df.collect()}


def some_rows(seed, n=60, span=90):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 2, 3, None]), day(rng.randrange(span)) if rng.random() > 0.05 else None, rng.choice([rng.uniform(-1, 1), None, float("nan"), 0.25]), "x", 1, 1.0) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_rolling_totals_match_a_loop(spark, seed):
    rows = some_rows(seed)
    assert as_lines(rolling.rolling_totals(readings(spark, rows), "security_id", "date", "v")) == rolling_by_hand(rows)


def test_rolling_of_nothing_and_of_one_row(spark):
    assert rolling.rolling_totals(readings(spark, []), "security_id", "date", "v").count() == 0
    assert as_lines(rolling.rolling_totals(readings(spark, [(1, D, 0.5, "", 1, 1.0)] * 2), "security_id", "date", "v")) == {(1, D): [2, 1.0, 0.5, 2, 1.0, 0.5]}


def amounts(spark, rows):
    return rolling.daily_amounts(readings(spark, rows), "security_id", "date", "v").withColumn("month", rolling.month_of("d")).cache()


def bounds(daily):
    return daily.agg({"d": "min"}).first()[0], daily.agg({"d": "max"}).first()[0]


@pytest.mark.parametrize(("seed", "days"), [(7, 1000), (8, 20), (9, 92)])
def test_the_store_carries_corrects_and_compacts(spark, tmp_path, seed, days):
    rows = [*some_rows(seed), (1, day(89), 1.0, "x", 1, 1.0)]
    late = [r for i, r in enumerate(rows[:-1]) if i % 9 == 0]
    in_time = [r for i, r in enumerate(rows) if i % 9 or i == len(rows) - 1]
    store = rolling.RollingStore(spark, str(tmp_path / "state"))
    first = store.load(amounts(spark, in_time), *bounds(amounts(spark, in_time)), days)
    assert as_lines(rolling.series(store.current(), "security_id")) == rolling_by_hand(in_time)
    fixed = store.correct(amounts(spark, late))
    assert fixed == len(first) + 1
    by_hand = rolling_by_hand(rows)
    assert as_lines(rolling.series(store.current(), "security_id")) == by_hand
    store.compact()
    assert as_lines(rolling.series(store.current(), "security_id")) == by_hand
    assert as_lines(rolling.series(store.current(fixed - 1), "security_id")) == rolling_by_hand(in_time)


def test_a_correction_reads_and_writes_the_days_it_affects(spark, tmp_path):
    rows = [(1, day(n), 1.0, "x", 1, 1.0) for n in range(200)]
    store = rolling.RollingStore(spark, str(tmp_path / "state"))
    daily = amounts(spark, rows)
    store.load(daily, *bounds(daily), 50)
    v = store.correct(amounts(spark, [(1, day(70), 1.0, "x", 1, 1.0)]))
    name = next(x[3] for x in store._all() if x[0] == v)
    wrote = spark.read.parquet(f"{store.root}/{name}")
    assert wrote.count() == 30 and wrote.where("d = %d" % (day(70) - dt.date(1970, 1, 1)).days).first()["n_7"] == 8
    touched = store.current(months=sorted({(day(n).year * 100 + day(n).month) for n in range(70, 100)}))
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in plan
    assert {r["d"] for r in touched.collect()} < {r["d"] for r in store.current().collect()}


def test_one_writer_at_a_time(spark, tmp_path):
    store = rolling.RollingStore(spark, str(tmp_path / "state"))
    daily = amounts(spark, [(1, day(n), 1.0, "x", 1, 1.0) for n in range(3)])
    lo, hi = bounds(daily)
    store.load(daily, lo, hi)
    assert store._claim() == 2  # a writer that dies here
    with pytest.raises(rolling.ConcurrentWrite):
        store.advance(daily, hi + 1)
    store.release(2)
    assert store.advance(daily, hi + 1) == 2
    with pytest.raises(ValueError, match="correction"):
        store.correct(amounts(spark, [(1, day(50), 1.0, "x", 1, 1.0)]))
    with pytest.raises(ValueError, match="has reached"):
        store.advance(daily, hi)


def test_an_empty_store_reads_as_nothing(spark, tmp_path):
    store = rolling.RollingStore(spark, str(tmp_path / "state"))
    assert store.current().count() == 0 and store.add(amounts(spark, [])) == []


def test_one_day_step_equals_the_history(spark):
    daily = rolling.daily_amounts(readings(spark, some_rows(5)), "security_id", "date", "v")
    whole = rolling.state_of(daily)
    at = (day(40) - dt.date(1970, 1, 1)).days
    key = lambda df: sorted(map(tuple, df.select("k", "d", "n_d", "n_7", "c_7", "s_7", "n_30", "c_30", "s_30").where(f"d = {at}").collect()))
    assert key(rolling.step(whole, daily, at)) == key(whole) != []


# ---------------------------------------------------------------- imputation


def test_em_raises_the_likelihood_and_uses_correlation(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, 4000)
    z = np.column_stack([a, 0.9 * a + rng.normal(0, 0.2, 4000)])
    hide = rng.random(4000) < 0.2
    rows = spark.createDataFrame([(float(x), None if h else float(y), int(x > 0)) for (x, y), h in zip(z, hide)], "z0 double, z1 double, w0 int")
    m = fit_mixture(rows, 2, [2], 2, 12)
    seen = z.copy()
    seen[hide, 1] = np.nan
    code = [np.array([int(x > 0) for x in z[:, 0]])]
    r = np.exp(m.log_joint(seen, code))
    r /= r.sum(axis=1, keepdims=True)
    guess = sum(r[:, [c]] * m.complete(seen, c)[0] for c in range(2))
    assert np.abs(guess[hide, 1] - z[hide, 1]).mean() < 0.25
    start = Mixture(np.array([0.5, 0.5]), np.zeros((2, 2)), np.array([np.eye(2), 2 * np.eye(2)]), [np.full((2, 2), 0.5)])
    first = start.statistics(seen, code)
    second = start.maximised(first).statistics(seen, code)
    assert second[0] >= first[0]


def test_em_goes_on_to_its_tolerance_and_tells_if_it_does_not(spark):
    rng = np.random.default_rng(1)
    z = np.r_[rng.normal(-1, 1, 600), rng.normal(1.2, 1, 600)]
    rows = spark.createDataFrame([(float(x),) for x in z], "z0 double")
    with pytest.warns(RuntimeWarning, match="not converged"):
        fit_mixture(rows, 1, [], 2, 2)
    m = fit_mixture(rows, 1, [], 2)
    here = m.statistics(z[:, None], [])
    then = m.maximised(here).statistics(z[:, None], [])
    assert then[0] - here[0] < 1e-5 * len(z)


CELLS = "row_id long, security_id long, date date, vol double, size double, sector string, regime string, g string, t int, row string"
FIELDS = ([Number("vol", 0, 1, log=True), Number("size", 0, 50)], [Word("sector", "group"), Word("regime", "time")])


def test_imputation_masks_fills_and_leaves(spark):
    rows = [(i, 1 + i % 2, day(i // 2), 0.02 + 0.001 * (i % 5), 15.0 + i % 2, "Tools" if i % 2 else "Glass", "High" if i // 2 % 2 else "Low", "g", 1, "r") for i in range(40)]
    put = lambda i, **kw: rows.__setitem__(i, tuple(kw.get(n.split()[0], v) for n, v in zip(CELLS.split(", "), rows[i])))
    put(10, vol=float("nan"), sector=" N/A ")
    put(11, size=-1.0, regime="?")
    put(0, vol=None)  # nothing earlier
    put(12, sector="GLASS")
    rows += [(100, None, day(3), None, 1.0, None, None, "", 0, ""), (101, 9, None, None, None, "", None, "", 0, ""), (102, 1, day(5), 99999.0, 12.0, "-", " ", "", 0, "")]
    got = {r["row_id"]: r for r in impute(spark.createDataFrame(rows, CELLS), "row_id", "security_id", "date", *FIELDS).collect()}
    assert len(got) == len(rows)
    assert got[10]["vol_filled"] and 0.015 < got[10]["vol"] < 0.03 and got[10]["sector"] == "Glass" and got[10]["sector_filled"]
    assert got[11]["size_filled"] and abs(got[11]["size"] - 16) < 0.6 and got[11]["regime"] == "High" and got[11]["regime_filled"]
    assert got[0]["vol"] is None and not got[0]["vol_filled"]
    assert got[12]["sector"] == "GLASS" and not got[12]["sector_filled"]
    assert got[100]["regime_filled"] and got[100]["sector"] is None and not got[100]["vol_filled"]
    assert got[101]["vol"] is None and got[101]["regime"] is None
    assert got[102]["vol_filled"] and got[102]["sector_filled"] and got[102]["regime_filled"]
    only = {r["row_id"] for r in impute(spark.createDataFrame(rows, CELLS), "row_id", "security_id", "date", *FIELDS, only_filled=True).collect()}
    assert only == {10, 11, 100, 102}


def test_imputation_of_an_empty_and_a_hopeless_table(spark):
    assert impute(spark.createDataFrame([], CELLS), "row_id", "security_id", "date", *FIELDS).count() == 0
    r = impute(spark.createDataFrame([(1, 1, D, None, None, None, None, None, None, None)], CELLS), "row_id", "security_id", "date", *FIELDS).first()
    assert r["vol"] is None and r["sector"] is None and not any(r[f"{c}_filled"] for c in ("vol", "size", "sector", "regime"))


# ---------------------------------------------------------------- grid


POINTS = "src string, date date, at timestamp_ntz, v double, day string, state int, o long"


def grid(spark, rows, **kw):
    return {(r["src"], r["day"]): r for r in regrid(spark.createDataFrame(rows, POINTS).drop("day", "state"), "src", "date", ["v"], at="at", tie="o", **kw).collect()}


def reading(src, n, v, hour=16, o=0):
    return (src, day(n), dt.datetime.combine(day(n), dt.time(hour)), v, "x", 1, o)


def test_grid_interpolates_between_neighbours_within_the_limit(spark):
    g = grid(spark, [reading("a", 0, 1.0), reading("a", 0, 2.0, 18), reading("a", 4, 6.0), reading("a", 25, 9.0), reading("b", 1, 5.0)])
    assert g["a", day(0)]["v"] == 2.0 and g["a", day(0)]["state"] == "observed"
    # neighbours: day 0 18:00 and day 4 16:00, 94 hours apart
    assert g["a", day(1)]["v"] == pytest.approx(2 + 4 * 22 / 94) and g["a", day(1)]["v_filled"] and g["a", day(1)]["state"] == "filled"
    assert g["a", day(7)]["state"] == "marked" and g["a", day(7)]["v"] is None
    assert ("a", day(5)) not in g and len([k for k in g if k[0] == "b"]) == 1
    assert len(g) == sum(1 for n in range(26) if day(n).weekday() < 5) + 1


def test_grid_with_missing_values_weekends_ties_and_repeats(spark):
    rows = [reading("a", 0, 1.0), reading("a", 0, 1.0), reading("a", 1, None), reading("a", 2, float("nan")), reading("a", 3, 4.0, o=1), reading("a", 3, 7.0, o=2), reading("a", 5, 9.0), reading("a", 7, 11.0), reading(None, 1, 1.0), ("a", None, None, 3.0, "", 0, 0)]
    g = grid(spark, rows)
    assert g["a", day(1)]["v"] == pytest.approx(2.0) and g["a", day(1)]["v_filled"] and g["a", day(1)]["had_reading"]
    assert g["a", day(3)]["v"] == 7.0
    assert g["a", day(4)]["v"] == pytest.approx(8.0)  # from the weekend's reading
    assert ("a", day(5)) not in g
    assert regrid(spark.createDataFrame([], POINTS), "src", "date", ["v"]).count() == 0


# ---------------------------------------------------------------- intervals


def merged_by_hand(rows):
    days = sorted({x for s, e in rows for x in range(s, e)})
    out = []
    for x in days:
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-40, 40), st.integers(1, 12)), max_size=40))
def test_linear_merge(rows):
    k, s, n = (np.array(c, np.int64) for c in (zip(*rows) if rows else ([], [], [])))
    got = list(zip(*(x.tolist() for x in intervals.merge_sorted(k, s, s + n))))
    assert got == [(key, a, b) for key in sorted({r[0] for r in rows}) for a, b in merged_by_hand([(x, x + y) for kk, x, y in rows if kk == key])]


def test_interval_tree_with_a_hot_key_equals_one_merge(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, rng.randrange(2, 9)]), day(a := rng.randrange(2000)), day(a + rng.randrange(1, 4)), "k", 1, 2) for _ in range(3000)]
    df = spark.createDataFrame(rows, "id long, a date, b date, k string, s int, slot int").repartition(12)
    got = sorted(tuple(r) for r in intervals.periods_and_gaps(df, "id", "a", "b", fan=4).collect())
    want = []
    for k in {r[0] for r in rows}:
        p = merged_by_hand([((x - D).days, (y - D).days) for i, x, y, *_ in rows if i == k])
        want += [(k, "period", day(a), day(b)) for a, b in p] + [(k, "gap", day(x[1]), day(y[0])) for x, y in zip(p, p[1:])]
    assert got == sorted(want)


def test_interval_edge_cases(spark):
    rows = [("a", D, day(5)), ("a", day(5), day(7)), ("a", D, day(5)), ("a", day(9), day(9)), ("a", day(9), day(8)), ("a", day(20), None), ("a", None, day(3)), (None, D, day(3)), ("b", day(1), day(2))]
    df = spark.createDataFrame(rows, "id string, a date, b date")
    assert sorted(tuple(r) for r in intervals.periods_and_gaps(df, "id", "a", "b").collect()) == [("a", "period", D, day(7)), ("b", "period", day(1), day(2))]
    assert intervals.periods_and_gaps(df.where("false"), "id", "a", "b").count() == 0


# ---------------------------------------------------------------- known time


@settings(max_examples=120, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 8), st.integers(0, 3), st.integers(0, 9), st.integers(1, 6)), max_size=30),
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10)), min_size=1, max_size=8),
    st.booleans(),
    st.booleans(),
)
def test_persistent_tree_lookup(rows, asks, inclusive, ends):
    rows = list(dict.fromkeys(rows))
    e, v, r, k, n = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 5))
    until = (v + n).astype(np.int32)
    rank = np.lexsort((until, k, r)).argsort() if len(e) else r
    ask = np.array(asks, np.int64)
    got = asof.lookup(e, v, rank, k, until if ends else None, ask[:, 0], ask[:, 1], inclusive)
    for (entity, d), i in zip(asks, got):
        ok = [j for j in range(len(rows)) if e[j] == entity and k[j] < d and (v[j] <= d if inclusive else v[j] < d) and (not ends or until[j] > d)]
        assert i == (max(ok, key=lambda j: (v[j], rank[j])) if ok else -1)


def test_as_known_edge_cases(spark):
    t = lambda n, h=1: dt.datetime.combine(day(n), dt.time(h))
    attrs = spark.createDataFrame(
        [(1, 5, D, day(9), t(0)), (2, 5, D, day(9), t(0)), (3, 5, day(2), day(3), t(0)), (4, 5, day(1), None, t(0)), (5, 5, day(1), day(9), None), (6, None, D, day(9), t(0)), (7, 5, day(1), day(9), t(4)), (None, 5, day(1), day(9), t(0)), (8, 5, day(4), day(4), t(0))],
        "id long, sec long, since date, until date, known timestamp_ntz",
    ).withColumn("k", F.lit("x"))
    ev = spark.createDataFrame([(5, day(n)) for n in (0, 1, 1, 2, 3, 4, 5, 9)] + [(None, D), (5, None), (6, day(3))], "sec long, on date").withColumn("d", F.lit(1))
    got = {(r["sec"], r["on"]): r["id"] for r in asof.as_known(ev, attrs, "sec", "on", "since", "known", "id", valid_until="until").collect()}
    assert got == {(5, day(1)): 2, (5, day(2)): 3, (5, day(3)): 2, (5, day(4)): 2, (5, day(5)): 7}
    strict = {r["on"]: r["id"] for r in asof.as_known(ev, attrs, "sec", "on", "since", "known", "id", inclusive=False).collect()}
    assert strict[day(1)] == 2 and strict[day(2)] == 4 and strict[day(9)] == 8
    assert asof.as_known(ev, attrs.where("false"), "sec", "on", "since", "known", "id").count() == 0
    assert asof.as_known(ev.where("false"), attrs, "sec", "on", "since", "known", "id").count() == 0


def test_imputation_is_the_same_without_broadcasts(spark, monkeypatch):
    from rankloom.operators import impute as module

    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 2, None]), day(rng.randrange(20)) if rng.random() > 0.05 else None, rng.choice([0.02, 0.03, None]), rng.choice([15.0, 16.0, -1.0]), rng.choice(["Tools", "glass", "?"]), rng.choice(["High", "Low", None]), "g", 1, "r") for i in range(200)]
    run = lambda: sorted(map(str, impute(spark.createDataFrame(rows, CELLS), "row_id", "security_id", "date", *FIELDS).collect()))
    whole = run()
    monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    again = run()
    assert len(whole) == 200
    assert [x.replace("True", "").split("size")[0] for x in whole] != [] and [("filled=True" in x) for x in whole] == [("filled=True" in x) for x in again]
