"""The k names a model sees: ranked by liquidity, refreshed on a schedule, with a retention buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.registry import register
from rankloom.sources.panel import calendar, indexed

AGGREGATES = ("sum", "mean", "median")


def refreshes(cal: DataFrame, start, end, ttl: int, need: int = 0) -> DataFrame:
    """(j, day_idx, refresh_date, valid_until): every ttl-th day of the period; one row per refresh."""
    inside = cal.where(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    w = W.orderBy("date")
    rows = inside.select("date", "day_idx", (F.col("day_idx") - F.min("day_idx").over(W.partitionBy())).alias("since"), F.max("date").over(W.partitionBy()).alias("last"))
    rows = rows.where(F.col("since") % ttl == 0).select((F.col("since") / ttl).cast("int").alias("j"), "day_idx", F.col("date").alias("refresh_date"), F.coalesce(F.lead("date").over(w), F.date_add("last", 1)).alias("valid_until"))
    return rows.where(F.col("day_idx") >= need) if need else rows


@register("filter", "topk_dollar_volume")
def topk_dollar_volume(panel: DataFrame, start, end, k: int, buffer_ratio: float = 0.1, x: int = 20, y: int = 30, ttl: int = 21, agg: str = "sum", on_delist: str = "keep", cal: DataFrame | None = None) -> DataFrame:
    """(refresh_date, valid_until, slot, security_id, is_pad): exactly k rows per refresh.

    Eligible is who has a record on the day before and on at least x of the y days before;
    order is by ``agg`` of close * volume over the last x calendar days, ties by security_id.  Of
    the first k + b, those of the period before stay, the rest fills up in order; slots number the
    chosen in order and missing ones are pads.

    One windowed pass serves all refreshes.  Only the first k + b per refresh leave it; the chain
    of refreshes, each depending on the one before, is folded over these (refreshes * (k + b)
    numbers, independent of the number of securities).
    """
    if y < x:
        raise ValueError("y must be at least x")
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {AGGREGATES}")
    if on_delist != "keep":
        raise NotImplementedError("on_delist: only 'keep'")
    cal = cal if cal is not None else calendar(panel)
    plan = refreshes(cal, start, end, ttl)
    first = plan.where("j = 0").select("day_idx").first()
    if first is not None and first[0] < y:
        raise ValueError(f"{y} days are needed before {start}")
    b = int(k * buffer_ratio)

    # of records with a close, those that lie in the y days before some refresh
    rows = indexed(panel, cal).select("security_id", "day_idx", "close", (F.col("close") * F.col("volume")).alias("dollar")).where("close is not null and security_id is not null")
    w = W.partitionBy("security_id").orderBy("day_idx")
    wx, wy = w.rangeBetween(-(x - 1), 0), w.rangeBetween(-(y - 1), 0)
    if agg == "median":
        held = F.array_sort(F.collect_list("dollar").over(wx))
        n = F.size(held)
        value = F.when(n > 0, (F.element_at(held, ((n + 1) / 2).cast("int")) + F.element_at(held, (n / 2).cast("int") + 1)) / 2)
    else:
        value = (F.coalesce(F.sum("dollar").over(wx), F.lit(0.0)) if agg == "sum" else F.avg("dollar").over(wx))
    scored = rows.select("security_id", (F.col("day_idx") + 1).alias("day_idx"), value.alias("score"), F.count(F.lit(1)).over(wy).alias("n")).where(F.col("n") >= x)
    ranked = scored.join(F.broadcast(plan.select("j", "day_idx")), "day_idx")
    order = W.partitionBy("j").orderBy(F.col("score").desc_nulls_last(), "security_id")
    top = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + b)

    lists = top.groupBy("j").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "security_id"))), lambda s: s["security_id"]).alias("ids"))
    none = F.array().cast("array<bigint>")
    chain = plan.join(lists, "j", "left").agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce("ids", none).alias("ids")))).alias("steps"))
    state = F.struct(none.alias("before"), F.array().cast("array<struct<j:int,ids:array<bigint>>>").alias("out"))

    def choose(acc, s):
        kept = F.array_intersect(s["ids"], acc["before"])
        fill = F.slice(F.array_except(s["ids"], acc["before"]), F.lit(1), F.greatest(F.lit(k) - F.size(kept), F.lit(0)))
        chosen = F.filter(s["ids"], lambda i: F.array_contains(kept, i) | F.array_contains(fill, i))
        return F.struct(chosen.alias("before"), F.concat(acc["out"], F.array(F.struct(s["j"].alias("j"), chosen.alias("ids")))).alias("out"))

    picked = chain.select(F.explode(F.aggregate("steps", state, choose)["out"]).alias("o")).select("o.j", "o.ids")
    slots = picked.select("j", "ids", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    slots = slots.select("j", "slot", F.when(F.size("ids") > 0, F.try_element_at("ids", F.col("slot") + 1)).alias("security_id"))
    return slots.join(plan, "j").select("refresh_date", "valid_until", F.col("slot").cast("int").alias("slot"), "security_id", F.col("security_id").isNull().alias("is_pad"))


def slots_by_day(universe: DataFrame, cal: DataFrame) -> DataFrame:
    """(date, day_idx, slot, security_id, is_pad): which name holds which slot on each day a period covers.

    The interval join in equi form: each day looks up the latest refresh at or before it, on the calendar alone.
    """
    periods = universe.select("refresh_date", "valid_until").distinct()
    days = cal.select("date", "day_idx", F.lit(None).cast("date").alias("refresh_date"), F.lit(None).cast("date").alias("valid_until"))
    marks = periods.select(F.col("refresh_date").alias("date"), F.lit(-1).alias("day_idx"), "refresh_date", "valid_until")
    w = W.orderBy("date", "day_idx").rowsBetween(W.unboundedPreceding, 0)  # over days and refreshes only
    held = days.unionByName(marks).select("date", "day_idx", F.last("refresh_date", ignorenulls=True).over(w).alias("refresh_date"), F.last("valid_until", ignorenulls=True).over(w).alias("until"))
    held = held.where((F.col("day_idx") >= 0) & (F.col("date") < F.col("until"))).select("date", "day_idx", "refresh_date")
    return universe.join(F.broadcast(held), "refresh_date").select("date", "day_idx", "slot", "security_id", "is_pad")
