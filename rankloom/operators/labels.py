"""Outcomes of decisions: compounded returns over the days that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.registry import register
from rankloom.sources.panel import calendar, indexed


@register("label", "forward_return")
def forward_return(panel: DataFrame, start=None, end=None, h: int = 5, offset: int = 0, cal: DataFrame | None = None) -> DataFrame:
    """(date, security_id, label) for decision days of the period, for names with a close on the day before.

    The label of decision day i compounds the returns of the calendar days [i + offset, i + offset + h):
    days without a record add nothing.  It is NULL unless the last of these days has a record with a
    return and no record among them lacks one.

    One range frame over day_idx, seen from the record of the day before: no grid is built.
    """
    cal = cal if cal is not None else calendar(panel)
    rows = indexed(panel, cal).where("security_id is not null").select("security_id", "day_idx", "close", "ret_total")
    w = W.partitionBy("security_id").orderBy("day_idx").rangeBetween(offset + 1, offset + h)
    r = F.col("ret_total")
    rows = rows.select(
        "security_id",
        "close",
        (F.col("day_idx") + 1).alias("day_idx"),
        F.sum(F.when(r > -1, F.log1p(r))).over(w).alias("logs"),
        F.max(F.when(r <= -1, 1).otherwise(0)).over(w).alias("lost"),
        F.max("day_idx").over(w).alias("last"),
        F.sum(F.when(r.isNull(), 1).otherwise(0)).over(w).alias("bad"),
    ).where("close is not null")
    ok = (F.col("last") == F.col("day_idx") + offset + h - 1) & (F.col("bad") == 0)
    value = F.when(ok, F.when(F.col("lost") == 1, F.lit(-1.0)).otherwise(F.expm1("logs")))
    out = rows.join(F.broadcast(cal), "day_idx").select("date", "security_id", value.alias("label"))
    if start is not None and end is not None:
        out = out.where(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    return out
