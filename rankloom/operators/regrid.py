"""Irregular readings onto a regular grid.

The grid is one entry per day (or per Monday-to-Friday day) between a source's first and
last reading.  Readings are first reduced, on the map side, to the earliest and the latest
usable reading of each (source, day): these are the only ones that can be a neighbour of a
grid point, so a source with a third of all readings shrinks to one row a day before
anything is ordered.  The as-of merge then runs over the ordered days of a source, once in
each direction, and the grid points between two days with readings are generated from
the pair that encloses them - the full grid is never joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.session import finite


def _weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def regrid(
    df: DataFrame, source: str, day: str, values: Sequence[str], at: str | None = None, tie: str | None = None, weekdays: bool = True, max_gap_days: float = 7.0, anchor_hours: float = 16.0
) -> DataFrame:
    """(source, day, had_reading, state, then for each value v: v and v_filled).

    A day with readings shows the latest usable reading of that day.  Any other grid
    point, and a value that no reading of its day has, is interpolated linearly in time
    between the last usable reading before and the first one after it, if these are at
    most ``max_gap_days`` apart; else it stays NULL.  ``at`` is the time of the reading
    (without it, the day at ``anchor_hours``); the grid point of a day lies at
    ``anchor_hours``.  ``tie`` orders readings of the same time.

    state: 'observed' (the day has a row), 'filled' (no row, every value interpolated) or
    'marked' (no row, some value left NULL).  Rows without source or day are left out; NaN
    and infinite values count as absent; readings on days off the grid serve as
    neighbours only.  Repeated readings change nothing.  Other columns are ignored.
    """
    stamp = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(86400e6) if at else F.unix_date(F.col(day).cast("date")) + F.lit(anchor_hours / 24)
    rows = df.select(
        F.col(source).alias("k"),
        F.unix_date(F.col(day).cast("date")).alias("d"),
        stamp.cast("double").alias("t"),
        (F.col(tie) if tie else F.lit(0)).cast("long").alias("o"),
        *[finite(v).alias(f"v{i}") for i, v in enumerate(values)],
    ).where(F.col("k").isNotNull() & F.col("d").isNotNull())
    held = [F.struct(F.coalesce("t", F.col("d").cast("double")).alias("t"), "o", F.col(f"v{i}").alias("v")) for i in range(len(values))]
    usable = [F.when(F.col(f"v{i}").isNotNull(), h) for i, h in enumerate(held)]
    cells = rows.groupBy("k", "d").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(u).alias(f"late{i}") for i, u in enumerate(usable)], *[F.min(u).alias(f"early{i}") for i, u in enumerate(usable)]
    )
    down = W.partitionBy("k").orderBy(F.col("d").desc()).rowsBetween(W.unboundedPreceding, 0)
    up = W.partitionBy("k").orderBy("d")
    cells = cells.select("*", *[F.last(f"early{i}", ignorenulls=True).over(down).alias(f"next{i}") for i in range(len(values))])
    upto = up.rowsBetween(W.unboundedPreceding, 0)
    cells = cells.select(
        "k",
        "d",
        F.lead("d").over(up).alias("d2"),
        *[F.struct(F.col(f"late{i}").alias("own"), F.last(f"late{i}", ignorenulls=True).over(upto).alias("prev"), F.lead(f"next{i}").over(up).alias("next")).alias(f"c{i}") for i in range(len(values))],
    )
    # the day itself, and the days up to the next one with readings
    grid = cells.select("*", F.explode(F.sequence("d", F.coalesce(F.col("d2") - 1, F.col("d")))).alias("g")).drop("d2")
    if weekdays:
        grid = grid.where(_weekday(F.date_from_unix_date("g")))
    here = F.col("g") == F.col("d")
    point = F.col("g") + F.lit(anchor_hours / 24)
    out = []
    for i, _ in enumerate(values):
        a, b, own = F.col(f"c{i}.prev"), F.col(f"c{i}.next"), F.col(f"c{i}.own")
        near = (b["t"] - a["t"] <= F.lit(float(max_gap_days))) & (b["t"] > a["t"])
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (point - a["t"]) / (b["t"] - a["t"])))
        fill = F.when(near, a["v"] + (b["v"] - a["v"]) * share)
        out.append((F.when(here & own.isNotNull(), own["v"]).otherwise(fill).alias(f"x{i}"), (~(here & own.isNotNull()) & fill.isNotNull()).alias(f"f{i}")))
    grid = grid.select("k", "g", here.alias("had_reading"), *[c for pair in out for c in pair])
    every = F.lit(True)
    for i, _ in enumerate(values):
        every = every & F.col(f"x{i}").isNotNull()
    state = F.when(F.col("had_reading"), "observed").when(every, "filled").otherwise("marked")
    cols = [c for i, v in enumerate(values) for c in (F.col(f"x{i}").alias(v), F.col(f"f{i}").alias(f"{v}_filled"))]
    return grid.select(F.col("k").alias(source), F.date_from_unix_date("g").alias("day"), "had_reading", state.alias("state"), *cols)
