"""Session, table access and the missing-value rule of the engine.

Stored tables use NULL for "no value"; NaN and infinities are turned into NULL when a
column enters an operator, because Spark orders NaN above every number and lets it
poison averages.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "rankloom", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session for tests and benches, with ``shared`` as its spark.checkpoint.dir; on a cluster the caller's own session is used."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared if "://" in shared else f"file://{shared}")
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def served_folder(spark: SparkSession, what: str) -> str:
    """A new folder for files that the driver hands out by addFile: in the shared folder where the driver has it mounted, else among its own files."""
    shared = shared_dir(spark).removeprefix("file://")
    try:
        if shared.startswith("/"):
            os.makedirs(shared, exist_ok=True)
            return tempfile.mkdtemp(prefix=f"rankloom-{what}-", dir=shared)
    except OSError:
        pass
    return tempfile.mkdtemp(prefix=f"rankloom-{what}-")


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of the session's executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(served_folder(spark, "code")) / "rankloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"rankloom/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach: spark.checkpoint.dir of the session.

    Only where that is unset and everything runs on this machine (tests) is a temporary folder made; elsewhere it is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = spark.sparkContext._jvm.System.getProperty("rankloom.shared")
        if not conf:
            conf = "file://" + tempfile.mkdtemp(prefix="rankloom-")
            spark.sparkContext._jvm.System.setProperty("rankloom.shared", conf)
    return conf.rstrip("/")


_scratch: list[str] = []


def clear_written() -> None:
    """Remove the tables that ``written`` made in this process; results that still read them must have been stored."""
    spark = SparkSession.getActiveSession()
    while _scratch and spark is not None:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; the folder's owner clears it
            return


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    if not _scratch:
        atexit.register(clear_written)
    _scratch.append(f"{shared_dir(spark)}/{what}-{os.getpid()}-{uuid.uuid4().hex[:12]}")
    return _scratch[-1]


def written(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Cut the lineage by writing a table (partitioned ``by`` columns) to the shared folder and reading it back.

    The files outlive the loss of any executor, unlike cached blocks.
    """
    path = scratch(df.sparkSession, what)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finite(c: Column | str) -> Column:
    """The number as DOUBLE, NULL where it is NaN or infinite."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when((c > F.lit(float("-inf"))) & (c < F.lit(float("inf"))), c)
