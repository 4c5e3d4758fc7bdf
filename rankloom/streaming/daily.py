"""Streams of readings: daily bars with a bound on lateness, and rolling state kept up to date.

An extension; the batch operators stay the reference for results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.rolling import RollingStore, daily_amounts
from rankloom.session import written


def daily_bars(stream: DataFrame, entity: str, at: str, value: str, late: str = "1 day") -> DataFrame:
    """(entity, day, n, total, low, high) per entity and day; a day is given out once the watermark has passed it, rows later than that are dropped."""
    rows = stream.select(F.col(entity).alias("k"), F.col(at).cast("timestamp").alias("t"), F.col(value).cast("double").alias("v")).where("k is not null and t is not null").withWatermark("t", late)
    g = rows.groupBy("k", F.window("t", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    return g.select(F.col("k").alias(entity), F.to_date("w.start").alias("day"), "n", "total", "low", "high")


def keep_rolling(stream: DataFrame, store: RollingStore, entity: str, day: str, value: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch becomes the next version of the rolling state, whatever days its rows are for.

    A batch that is delivered again after a failure is recognised by its number and not added twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        done = f"{store.root}/_batches/{number}"
        jvm = store.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(done)
        fs = path.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            return
        store.add(written(daily_amounts(batch, entity, day, value), "batch"))
        fs.mkdirs(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
