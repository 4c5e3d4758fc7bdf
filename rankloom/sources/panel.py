"""Sources: long panels (security_id, date, open, high, low, close, volume, adj_close, ret_total)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.columns import ratio
from rankloom.registry import register

PANEL = ("security_id", "date", "open", "high", "low", "close", "volume", "adj_close", "ret_total")


@register("source", "parquet_panel")
def parquet_panel(spark: SparkSession, path: str, start: dt.date | str | None = None, end: dt.date | str | None = None, columns: Sequence[str] = PANEL) -> DataFrame:
    """The stored panel between two days (inclusive); only the asked columns are read, and the range is pushed to the files."""
    df = spark.read.parquet(path)
    df = df.select(*[c for c in columns if c in df.columns]).withColumns({"date": F.col("date").cast("date"), "security_id": F.col("security_id").cast("long")})
    if start is not None and end is not None:
        df = df.where(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@register("source", "lineitem_weekly")
def lineitem_weekly(spark: SparkSession, path: str, start: dt.date | str | None = None, end: dt.date | str | None = None) -> DataFrame:
    """Weekly bars from order lines: security = supplier, day = Monday of the shipping week, close = value per unit.

    Sums are DECIMAL, so they do not depend on the order of the rows.
    """
    li = spark.read.parquet(path)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    bars = li.groupBy(F.col("l_suppkey").cast("long").alias("security_id"), F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).cast("date").alias("date")).agg(
        F.min_by(price, F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("dollar"),
        F.sum(F.col("l_quantity").cast("decimal(18,0)")).cast("double").alias("volume"),
    )
    bars = bars.withColumn("close", ratio(F.col("dollar"), F.col("volume")))
    w = W.partitionBy("security_id").orderBy("date")
    bars = bars.select("security_id", "date", "open", "high", "low", "close", "volume", F.col("close").alias("adj_close"), (ratio(F.col("close"), F.lag("close").over(w)) - 1).alias("ret_total"))
    if start is not None and end is not None:
        bars = bars.where(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    return bars


FIELDS = ("date", "open", "high", "low", "close", "volume")


def _by_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b["path"].to_pylist(), b["content"]):
            if not content.as_py().strip():
                continue
            t = csv.read_csv(pa.BufferReader(content.as_buffer()), parse_options=csv.ParseOptions(invalid_row_handler=lambda r: "skip"), read_options=csv.ReadOptions(), convert_options=csv.ConvertOptions(strings_can_be_null=True))
            found = {name.strip().lower().replace("\ufeff", ""): n for n, name in reversed(list(enumerate(t.column_names)))}  # the first of equal names
            columns = [t.column(found[f]).cast(pa.string()) if f in found else pa.nulls(len(t), pa.string()) for f in FIELDS]
            name = path.rsplit("/", 1)[-1].removesuffix(".csv")
            for part in pa.table([pa.array([name] * len(t), pa.string()), *columns], names=["name", *FIELDS]).to_batches():
                yield part


@register("source", "ticker_csv")
def ticker_csv(spark: SparkSession, path: str, start: dt.date | str | None = None, end: dt.date | str | None = None) -> DataFrame:
    """One CSV file per ticker (date, open, high, low, close, volume), the ticker being the file's name.

    Columns go by each file's own header, whatever its order, case, blanks and further columns; a file without one of the fields has NULL there.
    What does not parse is NULL; rows without a date or without any value are dropped, empty files give nothing.  A file, at most a row a day, is parsed in one task.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path", "content")
    text = raw.mapInArrow(_by_header, ", ".join(f"{c} string" for c in ("name", *FIELDS)))
    df = text.select(F.trim("date").try_cast("date").alias("date"), *[F.trim(c).try_cast("double").alias(c) for c in FIELDS[1:]], F.regexp_replace(F.url_decode("name"), r"\.", "-").alias("ticker"))
    df = df.where("date is not null").dropna("all", subset=list(FIELDS[1:]))
    return df if start is None or end is None else df.where(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


@register("source", "factor_csv")
def factor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily factor returns (date as yyyyMMdd, then factors in percent): as fractions."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    first, *rest = raw.columns
    return raw.select(F.try_to_timestamp(F.trim(F.col(f"`{first}`").cast("string")), F.lit("yyyyMMdd")).cast("date").alias("date"), *[(F.col(f"`{c}`").try_cast("double") / 100).alias(c.strip()) for c in rest]).where("date is not null")


def write_ticker_csv(bars: DataFrame, path: str, by: str = "ticker") -> None:
    """One folder of CSV files per ticker; rows of a ticker meet in one task, a day apart."""
    bars.repartition(by).sortWithinPartitions(by, "date").write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def calendar(panel: DataFrame) -> DataFrame:
    """(date, day_idx): the distinct days of a panel, numbered from 0.

    As many rows as there are days, hence small whatever the panel; the single-task window is over these only.
    """
    return panel.select("date").where("date is not null").distinct().select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("day_idx"))


def indexed(panel: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """The panel with day_idx, its position on the calendar (a broadcast of one row a day)."""
    return panel.join(F.broadcast(cal if cal is not None else calendar(panel)), "date")
