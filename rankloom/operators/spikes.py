"""Implausible spikes, stuck values and impossible readings, each against its own source.

Per source a robust autoregression of the changes of the level (log of the reading) gives the
innovations e and the usual spread.  Then, over and over until nothing more is found, two
statistics are held against each other at every reading, both weighted by what the
autoregression's filter makes of the event:

* additive outlier of p = 1 .. ``patch`` readings: the level leaves and returns, so e shows
  (1, -phi, ..., -1, phi), overlaid for p = 1;
* level shift: the level leaves and stays, so e shows (1, -phi); such a move is honest.

All readings of an outlier are off, and the level that it leaves and returns to is that of the AROUND readings on each side.
Of overlapping events the one with the largest statistic is taken, shifts of a series once no more outliers are found there.  An outlier by more than ``limit``
usual spreads is a spike and leaves the series, a shift of that size leaves the innovations; spread and
autoregression are estimated anew.  Deviations of more than ``patch`` readings that return are two level shifts.
At the ends of a series an outlier and a shift look the same; there the reported return decides.
A return is a spike if it is that large and the clean readings around it did not make the
move.  Stuck runs (equal values over consecutive traded readings) and values beyond the
physical limits are found apart from these.

Distribution: rows are first reduced to one reading of a (source, day) on the map side, so a series holds at
most one row a calendar day whatever share of the rows its source has (a century has 36,525; the whole range
of DATE comes to 150 MB).  Whole series are worked off in shards of about SHARD_ROWS readings with array operations; no
series is cut.  Other readings of the same day are never collected: each row is held on its own against the
neighbourhood of its day, which the series' pass gives out for such days.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 1 << 17
AROUND = 5  # readings on each side that tell the level around
REASONS = ("spike_value", "spike_return", "stuck_value", "stuck_return", "impossible")
DEFAULTS = {"limit": 10.0, "patch": 4, "repeats": 6, "value_max": 1e12, "return_max": 10.0}
_CONTEXT = ("spread", "centre", "path", "before", "after", "run_v_before", "run_v_after", "run_r_before", "run_r_after", "v_before", "v_after", "r_before", "r_after")


def _segment_median(v: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """Median of the finite v per segment; NaN where there is none."""
    ok = np.isfinite(v)
    v, seg = v[ok], seg[ok]
    order = np.lexsort((v, seg))
    v = v[order]
    count = np.bincount(seg, minlength=n)
    start = np.cumsum(count) - count
    out = np.full(n, np.nan)
    has = count > 0
    lo, hi = start[has] + (count[has] - 1) // 2, start[has] + count[has] // 2
    out[has] = (v[lo] + v[hi]) / 2
    return out


def _spread(r: np.ndarray, seg: np.ndarray, n: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre, and standard deviation of the returns within ``cut`` robust spreads of it."""
    mid = _segment_median(r, seg, n)
    mad = 1.4826 * _segment_median(np.abs(r - mid[seg]), seg, n)
    ok = np.isfinite(r) & (np.abs(r - mid[seg]) <= cut * mad[seg])
    k = np.bincount(seg[ok], minlength=n)
    mean = np.bincount(seg[ok], r[ok], minlength=n) / np.maximum(k, 1)
    var = np.bincount(seg[ok], (r[ok] - mean[seg[ok]]) ** 2, minlength=n) / np.maximum(k - 1, 1)
    return mid, np.where((k >= 8) & (var > 0), np.sqrt(var), np.nan)


def _autoregression(d: np.ndarray, seg: np.ndarray, sd: np.ndarray, n: int) -> np.ndarray:
    """Coefficient of d[t] on d[t-1] per segment by Huber-weighted least squares, repeated until it stands; d is NaN at the start of a segment."""
    y, x = d[1:], d[:-1]
    ok = np.isfinite(y) & np.isfinite(x) & (seg[1:] == seg[:-1])
    y, x, s = y[ok], x[ok], seg[1:][ok]
    scale = sd[s]
    use = np.isfinite(scale)
    y, x, s, scale = y[use], x[use], s[use], scale[use]
    phi = np.zeros(n)
    lever = 1 / np.maximum(1.0, (x / scale / 3) ** 2)
    for _ in range(50):  # a contraction; the coefficient only weights the statistics, so the last digits don't matter
        res = (y - phi[s] * x) / scale
        w = lever * 1.5 / np.maximum(np.abs(res), 1.5)
        a, b = np.bincount(s, w * x * y, minlength=n), np.bincount(s, w * x * x, minlength=n)
        last, phi = phi, np.clip(np.where(b > 0, a / np.where(b > 0, b, 1), 0), -0.9, 0.9)
        if np.abs(phi - last).max(initial=0.0) < 1e-6:
            break
    return phi


def _run_lengths(v: np.ndarray, seg: np.ndarray, traded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(readings of the run up to each reading, readings from it on, whether it is a repeat): runs of equal, consecutive, traded readings; 0 where not traded."""
    n = len(v)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    same = np.r_[False, (v[1:] == v[:-1]) & (seg[1:] == seg[:-1]) & traded[1:] & traded[:-1]]
    head = np.maximum.accumulate(np.where(~same, np.arange(n), 0))
    size = np.bincount(head, minlength=n)[head]
    upto = np.arange(n) - head + 1
    live = traded & np.isfinite(v)
    return np.where(live, upto, 0), np.where(live, size - upto + 1, 0), same


def _shifted(v: np.ndarray, own: np.ndarray, by: int, empty: float) -> np.ndarray:
    """v[t + by] where that lies in the same segment, else ``empty``."""
    n = len(v)
    out = np.full(n, empty)
    if by >= 0 and by < n:
        out[: n - by] = np.where(own[by:] == own[: n - by], v[by:], empty)
    elif by < 0 and -by < n:
        out[-by:] = np.where(own[:by] == own[-by:], v[:by], empty)
    return out


def _near_median(x: np.ndarray, seg: np.ndarray, at: np.ndarray, offsets: range) -> np.ndarray:
    """Median of x at ``at + offset`` within the segment of ``at``."""
    i = at[:, None] + np.array(offsets)[None, :]
    j = np.clip(i, 0, max(len(x) - 1, 0))
    v = np.where((i == j) & (seg[j] == seg[at][:, None]), x[j], np.nan)
    return np.nanmedian(v, axis=1) if len(at) else np.zeros(0)


def _events(xs: np.ndarray, d: np.ndarray, sg: np.ndarray, phi: np.ndarray, s: np.ndarray, limit: float, patch: int) -> tuple[np.ndarray, np.ndarray]:
    """(readings in additive outliers, readings with a level shift) found in one round."""
    f = phi[sg]
    calm = np.nan_to_num(d)
    e = calm - f * _shifted(calm, sg, -1, 0.0)
    n = len(d)
    at = [_shifted(e, sg, k, 0.0) for k in range(patch + 2)]
    inside = ~np.isnan(d)  # the first reading has no way in
    found: list[tuple[np.ndarray, np.ndarray, int]] = []  # start, statistic, readings (0: a shift)
    with np.errstate(invalid="ignore"):
        w = 1 + f * f
        size = (e - f * at[1]) / w
        i = np.flatnonzero(inside & (np.abs(size) > limit * s))
        found.append((i, (np.abs(size) * np.sqrt(w) / s)[i], 0))
        for p in range(1, patch + 1):
            if p == 1:
                w = 1 + (1 + f) ** 2 + f * f
                size = (e - (1 + f) * at[1] + f * at[2]) / w
            else:
                w = 2 * (1 + f * f)
                size = (e - f * at[1] - at[p] + f * at[p + 1]) / w
            back = inside & np.isfinite(_shifted(d, sg, p, np.nan))
            i = np.flatnonzero(back & (np.abs(size) > limit * s))
            # all its readings are off, and what it leaves and returns to is the level around, not two outliers on either side of ordinary readings
            level, far = (xs[i - 1] + xs[i + p]) / 2, np.abs(size[i]) / 2
            off = np.logical_and.reduce([np.sign(size[i]) * (xs[i + k] - level) > far for k in range(p)])
            i = i[off & (np.abs(_near_median(xs, sg, i - 1, range(-AROUND + 1, 1)) - level) < far) & (np.abs(_near_median(xs, sg, i + p, range(AROUND)) - level) < far)]
            found.append((i, (np.abs(size) * np.sqrt(w) / s)[i], p))
    best = np.zeros(n + patch + 2)
    for i, tau, p in found:
        for k in range(p + 1):
            np.maximum.at(best, i + k, tau)
    outlier, shift = np.zeros(n, bool), np.zeros(n, bool)
    for i, tau, p in found:
        won = np.logical_and.reduce([best[i + k] <= tau for k in range(p + 1)]) if len(i) else np.zeros(0, bool)
        if p == 0:
            shift[i[won]] = True
        for k in range(p):
            outlier[i[won] + k] = True
    return outlier, shift & ~outlier


def detect(seg: np.ndarray, value: np.ndarray, ret: np.ndarray, volume: np.ndarray, limit: float = 10.0, patch: int = 4, repeats: int = 6, value_max: float = 1e12, return_max: float = 10.0) -> dict[str, np.ndarray]:
    """Flags per reading, and what another reading in its place would be held against.

    seg numbers the series 0.. in order; readings of a series are consecutive and in order of time; NaN is missing.
    """
    n, size = int(seg[-1]) + 1 if len(seg) else 0, len(seg)
    bad_value = ~np.isnan(value) & ((value <= 0) | ~np.isfinite(value) | (value >= value_max))
    bad_return = ~np.isnan(ret) & (~np.isfinite(ret) | (np.abs(ret) >= return_max))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(bad_value | np.isnan(value), np.nan, np.log(np.where(value > 0, value, 1.0)))
    r = np.where(bad_return, np.nan, ret)
    traded = np.nan_to_num(volume, nan=0.0) > 0
    spike, spike_r, shift = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
    at = np.arange(size)
    first_of, past = np.searchsorted(seg, np.arange(n)), np.searchsorted(seg, np.arange(n), side="right")
    start, end = (first_of[seg], past[seg]) if size else (at, at)
    inner = lambda i: np.clip(i, 0, max(size - 1, 0))
    seen: set[bytes] = set()
    while True:
        mid, sd = _spread(np.where(spike_r, np.nan, r), seg, n, limit)
        good = np.flatnonzero(np.isfinite(x) & ~spike)
        xs, sg, rr = x[good], seg[good], r[good]
        d = np.r_[np.nan, np.where(sg[1:] == sg[:-1], np.diff(xs), np.nan)] if len(xs) else xs
        quiet = np.where(shift[good] & ~np.isnan(d), 0.0, d)
        _, sd_x = _spread(d, sg, n, limit)
        sd = np.where(np.isfinite(sd), sd, sd_x)
        phi = _autoregression(quiet, sg, sd, n)
        s = sd[sg]
        outlier, moved = _events(xs, quiet, sg, phi, s, limit, patch)
        # at either end there is nothing to return to: the reported return is nearer to no move than to the jump
        with np.errstate(invalid="ignore"):
            unlike = (np.abs(d) > limit * s) & (np.abs(rr) < np.abs(rr - d)) & ~outlier
        change = sg[1:] != sg[:-1]
        at_end = unlike & np.r_[change, True] if len(xs) else unlike
        at_start = np.r_[unlike[1:] & np.r_[True, change][:-1] & ~change, False] if len(xs) else unlike
        found = outlier | at_end | at_start
        # a shift beside an outlier may be part of it: shifts of a series wait until no more outliers are found there
        moved &= ~shift[good] & (np.bincount(sg, found, minlength=n) == 0)[sg]
        spike[good[found]] = True
        shift[good[moved]] = True
        # returns: large ones that the clean readings on both sides don't show
        clean = np.isfinite(x) & ~spike
        prev = np.maximum.accumulate(np.where(clean, at, -1))
        prev = np.r_[-1, prev[:-1]] if size else prev
        nxt = np.minimum.accumulate(np.where(clean, at, size)[::-1])[::-1]
        move = np.where((prev >= start) & (nxt < end), x[inner(nxt)] - x[inner(prev)], 0.0) if size else x
        with np.errstate(invalid="ignore"):
            large = np.abs(r - mid[seg]) > limit * sd[seg]
            kept = (np.abs(r - move) < np.abs(move)) & ~(spike & np.isfinite(x))
        now = large & ~kept
        # spikes and shifts only become more; the returns' flags, once these stand, may come round to an earlier state
        still = not found.any() and not moved.any()
        ended = still and ((now == spike_r).all() or now.tobytes() in seen)
        seen = seen | {now.tobytes()} if still else set()
        spike_r = now
        if ended:
            break
    v_upto, v_from, v_same = _run_lengths(x, seg, traded)
    r_upto, r_from, r_same = _run_lengths(r, seg, traded)
    later = np.r_[nxt[1:], size] if size else nxt
    has_a, has_b = (prev >= start), (later < end)
    a, b = np.where(has_a, x[inner(prev)], np.nan) if size else x, np.where(has_b, x[inner(later)], np.nan) if size else x
    slope = np.zeros(size)
    if len(xs):
        slope[good] = np.clip(np.nan_to_num(d), -2 * s, 2 * s)
    beyond = np.r_[nxt, size, size][later + 1] if size else nxt
    onward = np.where(beyond < end, slope[inner(beyond)], 0.0) if size else slope
    path = (a + phi[seg] * slope[inner(prev)] + b - phi[seg] * onward) / 2 if size else x
    near = lambda v, by: _shifted(v.astype(float), seg, by, np.nan)
    return {
        "spike_value": spike,
        "spike_return": spike_r,
        "stuck_value": v_same & (v_upto + v_from - 1 > repeats),
        "stuck_return": r_same & (r_upto + r_from - 1 > repeats),
        "impossible": bad_value | bad_return,
        "spread": sd[seg], "centre": mid[seg], "path": path, "before": a, "after": b,
        "run_v_before": near(v_upto, -1), "run_v_after": near(v_from, 1), "run_r_before": near(r_upto, -1), "run_r_after": near(r_from, 1),
        "v_before": near(value, -1), "v_after": near(value, 1), "r_before": near(r, -1), "r_after": near(r, 1),
    }


def _work(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    def answer(t: pa.Table) -> pa.RecordBatch:
        k = t["k"].combine_chunks().dictionary_encode()
        k = k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k
        code = k.indices.to_numpy()
        seg = np.cumsum(np.r_[0, code[1:] != code[:-1]])
        flags = detect(seg, *(t[c].to_numpy().astype(float) for c in ("value", "ret", "volume")), **options)
        hit = np.flatnonzero(np.logical_or.reduce([flags[c] for c in REASONS]) | t["more"].to_numpy())
        at = pa.array(hit)
        numbers = [pa.array(flags[c][hit].astype(float), mask=np.isnan(flags[c][hit].astype(float))) for c in _CONTEXT]
        return pa.RecordBatch.from_arrays([*(t[c].combine_chunks().take(at) for c in ("k", "d", "value", "ret")), *[pa.array(flags[c][hit]) for c in REASONS], *numbers], names=["k", "d", "value", "ret", *REASONS, *_CONTEXT])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= SHARD_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            k = t["k"]
            cut = int(np.argmax(np.asarray(pa.compute.equal(k, k[-1]).to_numpy(), bool)))
            if cut:
                yield answer(t.slice(0, cut).combine_chunks())
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield answer(pa.Table.from_batches(held).combine_chunks())


def _number(c: str) -> Column:
    """As DOUBLE; NaN is missing, infinities stay (they are impossible, not missing)."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _rows(df: DataFrame, source: str, day: str, value: str, ret: str, volume: str, pick: str) -> DataFrame:
    return df.select(F.col(source).alias("k"), F.unix_date(F.col(day).cast("date")).alias("d"), F.col(pick).alias("o"), *[_number(c).alias(n) for c, n in ((value, "value"), (ret, "ret"), (volume, "volume"))])


def _days(rows: DataFrame, kind: str, options: dict) -> DataFrame:
    """(k, d, value, ret, REASONS, neighbourhood) of the days whose first reading is implausible or that have unlike readings."""
    spans = [F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1)))) for c in ("value", "ret")]
    days = rows.where("k is not null and d is not null").groupBy("k", "d").agg(F.min(F.struct("o", "value", "ret", "volume")).alias("x"), (~(spans[0] & spans[1])).alias("more"))
    days = days.select("k", "d", "x.value", "x.ret", "x.volume", "more").repartition("k").sortWithinPartitions("k", "d")
    columns = ", ".join([f"k {kind}, d int, value double, ret double", *[f"{c} boolean" for c in REASONS], *[f"{c} double" for c in _CONTEXT]])
    return days.mapInArrow(lambda it: _work(it, options), columns)


def _in_its_place(o: dict) -> dict[str, Column]:
    """The flags of a row's own reading (aliased o) in the place of its day's first one (aliased f), all other days by their first readings."""
    own, v, r = (lambda c: F.col(f"o.{c}")), F.col("o.value"), F.col("o.ret")
    f = lambda c: F.col(f"f.{c}")
    bad_v = (v <= 0) | (v >= o["value_max"])
    bad_r = F.abs(r) >= o["return_max"]
    x, a, b, limit = F.when(~bad_v, F.ln(v)), f("before"), f("after"), f("spread") * o["limit"]
    largest = F.greatest(F.abs(x - a), F.abs(x - b))
    outlier = (F.abs(x - f("path")) > limit) & (F.abs(x - f("path")) * 2**0.5 > largest)
    jump = x - F.coalesce(a, b)
    said = F.when(a.isNotNull(), r)  # the first reading of a series has no return of its own
    at_end = (F.abs(jump) > limit) & (F.abs(said) < F.abs(said - jump))
    yes = lambda c: F.coalesce(c, F.lit(False))
    spike = F.when(a.isNotNull() & b.isNotNull(), yes(outlier)).otherwise(yes(at_end))
    move = F.coalesce(F.when(spike | x.isNull(), b).otherwise(x) - a, F.lit(0.0))
    large = F.when(~bad_r, F.abs(r - f("centre")) > limit)
    traded = yes(own("volume") > 0)

    def stuck(z: Column, kind: str) -> Column:
        left = F.when(F.col(f"f.{kind}_before") == z, f(f"run_{kind}_before")).otherwise(0)
        right = F.when(F.col(f"f.{kind}_after") == z, f(f"run_{kind}_after")).otherwise(0)
        return yes(traded & (left > 0) & (left + right + 1 > o["repeats"] + 0))

    return {
        "spike_value": spike,
        "spike_return": yes(large) & ~(yes(F.abs(r - move) < F.abs(move)) & ~spike),
        "stuck_value": stuck(F.when(~bad_v, v), "v"),
        "stuck_return": stuck(F.when(~bad_r, r), "r"),
        "impossible": yes(bad_v) | yes(bad_r),
    }


def implausible(df: DataFrame, row: str, source: str, day: str, value: str, ret: str, volume: str, **options) -> DataFrame:
    """(row, REASONS...): every row, repeated ones too, with an implausible reading, and why; row is a unique id.

    value is the level (a price), ret its log return, volume marks traded days.  Of several rows of a source and day the one
    with the lowest id stands in the series; every other one is tested in its place, against the first readings of all other days.
    Rows without source or day are left out; missing and NaN values are no case in themselves, infinities are impossible.
    A source with fewer than 8 usable returns and changes has no usual spread and so no
    spikes, but stuck and impossible readings are still found.  Other columns are ignored; an empty table gives an empty result.
    Options are those of ``detect``.
    """
    o = DEFAULTS | options
    rows = _rows(df, source, day, value, ret, volume, row)
    found = _days(rows, df.schema[source].dataType.simpleString(), o)
    both = rows.alias("o").join(found.alias("f"), (F.col("o.k") == F.col("f.k")) & (F.col("o.d") == F.col("f.d")))
    same = F.col("o.value").eqNullSafe(F.col("f.value")) & F.col("o.ret").eqNullSafe(F.col("f.ret"))
    other = _in_its_place(o)
    out = both.select(F.col("o.o").alias(row), *[F.when(same, F.col(f"f.{c}")).otherwise(other[c]).alias(c) for c in REASONS])
    return out.where(" or ".join(REASONS))


def implausible_days(df: DataFrame, source: str, day: str, value: str, ret: str, volume: str, pick: str, **options) -> DataFrame:
    """(source, day, REASONS...): the days of each source with an implausible reading in the sense of ``implausible``; ``pick`` orders rows of the same source and day."""
    o = DEFAULTS | options
    rows = _rows(df, source, day, value, ret, volume, pick)
    found = _days(rows, df.schema[source].dataType.simpleString(), o)
    both = rows.alias("o").join(found.alias("f"), (F.col("o.k") == F.col("f.k")) & (F.col("o.d") == F.col("f.d")))
    same = F.col("o.value").eqNullSafe(F.col("f.value")) & F.col("o.ret").eqNullSafe(F.col("f.ret"))
    other = _in_its_place(o)
    out = both.select(F.col("o.k").alias("k"), F.col("o.d").alias("d"), *[F.when(same, F.col(f"f.{c}")).otherwise(other[c]).alias(c) for c in REASONS])
    out = out.groupBy("k", "d").agg(*[F.max(c).alias(c) for c in REASONS]).where(" or ".join(REASONS))
    return out.select(F.col("k").alias(source), F.date_from_unix_date("d").alias(day), *REASONS)
