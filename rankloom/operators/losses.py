"""Training losses as metrics: per day over the labelled names, then the mean over days with at least two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.registry import register


TARGETS = ("zscore", "raw")  # what the squared error is measured against: labels of the day standardised, or as they are


@register("loss", "hybrid_hinge")
def hybrid_hinge(df: DataFrame, margin: float = 0.1, decile: float = 0.1, lambda_mse: float = 1.0, target: str = "zscore") -> DataFrame:
    """(date, loss): mean hinge over all pairs of the day's top and bottom labels, plus lambda times the mean squared error.

    The pairs are not formed: with both tails in order of score, the sum over the pairs of a long
    is a count and a sum of the shorts that lie within the margin below it - two running sums.
    """
    if target not in TARGETS:
        raise ValueError(f"no target {target!r}; there are {', '.join(TARGETS)}")
    day = W.partitionBy("date")
    rows = df.where("score is not null and label is not null").select("date", "security_id", "score", "label", F.count(F.lit(1)).over(day).alias("n")).where("n >= 2")
    y = (F.col("label") - F.avg("label").over(day)) / (F.stddev_samp("label").over(day) + F.lit(1e-8)) if target == "zscore" else F.col("label")
    rows = rows.withColumn("y", y)
    order = day.orderBy("label", "security_id")
    tail = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(decile)).cast("int"))
    rows = rows.withColumns({"r": F.row_number().over(order), "tail": tail})
    long, short = F.col("r") > F.col("n") - F.col("tail"), F.col("r") <= F.col("tail")
    mse = rows.groupBy("date").agg(F.avg((F.col("score") - F.col("y")) ** 2).alias("mse"), F.max("tail").alias("tail"))
    # a name can be in both tails only when they overlap; each role is its own row
    roles = rows.select("date", F.explode(F.array_compact(F.array(F.when(long, F.struct(F.lit(1).alias("long"), (F.col("score") - margin).alias("key"))), F.when(short, F.struct(F.lit(0).alias("long"), F.col("score").alias("key")))))).alias("x")).select("date", "x.long", "x.key")
    above = day.orderBy(F.col("key").desc(), F.col("long").desc()).rowsBetween(W.unboundedPreceding, 0)
    is_short = F.col("long") == 0
    seen = roles.select("date", "long", "key", F.sum(F.when(is_short, F.col("key")).otherwise(0.0)).over(above).alias("s"), F.sum(F.when(is_short, 1).otherwise(0)).over(above).alias("c"))
    hinge = seen.where("long = 1").groupBy("date").agg(F.sum(F.col("s") - F.col("c") * F.col("key")).alias("pairs"))
    return hinge.join(mse, "date").select("date", (F.col("pairs") / (F.col("tail").cast("double") * F.col("tail")) + F.lit(lambda_mse) * F.col("mse")).alias("loss"))


@register("loss", "neg_pearson_rank")
def neg_pearson_rank(df: DataFrame) -> DataFrame:
    """(date, loss): minus the correlation of the score with the label's ordinal rank (ties by security_id)."""
    day = W.partitionBy("date")
    rows = df.where("score is not null and label is not null").select("date", "score", F.row_number().over(day.orderBy("label", "security_id")).cast("double").alias("r"))
    n = F.count(F.lit(1))
    cross, ss, rr = (F.covar_pop("score", "r") * n), F.sqrt(F.var_pop("score") * n), F.sqrt(F.var_pop("r") * n)
    return rows.groupBy("date").agg((-(cross / (ss * rr + F.lit(1e-8)))).alias("loss"), n.alias("n")).where("n >= 2").select("date", "loss")


@register("loss", "squared_error")
def squared_error(df: DataFrame) -> DataFrame:
    """(date, loss): mean squared distance of the score from the label."""
    rows = df.where("score is not null and label is not null").groupBy("date").agg(F.avg((F.col("score") - F.col("label")) ** 2).alias("loss"), F.count(F.lit(1)).alias("n"))
    return rows.where("n >= 2").select("date", "loss")


def mean_loss(days: DataFrame) -> DataFrame:
    return days.agg(F.avg("loss").alias("value"))


def validation_ic(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value): mean over days of the correlation of ordinal ranks; days with fewer than two names or no spread are left out; 0 if none."""
    key = [*by, "date"]
    day = W.partitionBy(*key)
    rows = df.where("score is not null and label is not null").select(*key, F.row_number().over(day.orderBy("score", "security_id")).cast("double").alias("a"), F.row_number().over(day.orderBy("label", "security_id")).cast("double").alias("b"))
    per = rows.groupBy(*key).agg(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("ic"))
    return per.groupBy(*by).agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("value"))
