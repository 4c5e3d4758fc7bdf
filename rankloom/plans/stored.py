"""Queries that go through specs, stored versions and runs, on weekly bars made from the order lines."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.columns import rounded
from rankloom.plans import pipeline
from rankloom.plans import reference as q
from rankloom.plans import reference_sql as s
from rankloom.plans.runs import Run
from rankloom.plans.spec import Spec, parse
from rankloom.session import scratch

WARMUP = 200
COST = {"min_stocks": q.MIN_STOCKS}


@lru_cache
def _root(application: str, sf: str) -> str:
    """One folder per application and tables, so that queries share what is built."""
    return scratch(SparkSession.getActiveSession(), "stored")


def spec_of(spark: SparkSession, sf: str, h: int = 5) -> Spec:
    root = _root(spark.sparkContext.applicationId, sf)
    return parse({
        "name": "bars",
        "paths": {"warehouse": f"{sf}/lineitem.parquet", "data_root": f"{root}/data", "runs_root": f"{root}/runs"},
        "data_spec": {"dataset_name": "bars", "source": {"func": "lineitem_weekly"}, "period": {"start": q.START, "end": q.END}, "warmup_days": WARMUP},
        "feature_spec": q.FEATURES, "filter_spec": {"func": "topk_dollar_volume", "kwargs": q.TOPK}, "indicator_spec": q.INDICATORS, "label_spec": {"func": "forward_return", "kwargs": {"h": h}},
        "window_spec": {"lookback": q.LOOKBACK, "max_missing": q.MISSING, "transforms": [{"func": "cs_zscore"}, {"func": "clip"}]},
        "model_spec": {"func": "window_ridge"}, "loss_spec": {"func": "squared_error"}, "split_spec": {"func": "purged_walk_forward", "kwargs": q.SPLIT},
        "train_spec": {"min_valid_slots": q.MIN_STOCKS}, "evaluation_spec": {"metrics": [{"func": "mean_ic", "kwargs": COST}, {"func": "decile_spread", "kwargs": {**COST, "n": q.BUCKETS}}]},
    })


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    spec = spec_of(spark, sf)
    return pipeline.store_of(spark, spec).read(table, pipeline.build(spark, spec)[table])


def stored_versions(spark: SparkSession, sf: str) -> DataFrame:
    """What the manifest says of the four tables of a spec."""
    spec = spec_of(spark, sf)
    built = pipeline.build(spark, spec)
    rows = [(v["table_name"], v["n_rows"], v["min_date"], v["max_date"]) for v in pipeline.store_of(spark, spec).versions() if built[v["table_name"]] == v["config_hash"]]
    return spark.createDataFrame(rows, "table_name string, n_rows long, min_date string, max_date string")


def stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the period, read back as they are stored (FLOAT)."""
    f = _read(spark, sf, "features").where(F.col("date") >= F.lit(q.START).cast("date"))
    return f.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "security_id", *[rounded(F.col(n).cast("double"), 4).alias(n) for n in q.NAMES])


def stored_labels(spark: SparkSession, sf: str) -> DataFrame:
    return q._round(_read(spark, sf, "labels"))


def stored_universe(spark: SparkSession, sf: str) -> DataFrame:
    return q._round(_read(spark, sf, "universe"))


def stored_market(spark: SparkSession, sf: str) -> DataFrame:
    return q._round(_read(spark, sf, "market").where(F.col("date") >= F.lit(q.START).cast("date")))


def unused_versions(spark: SparkSession, sf: str) -> DataFrame:
    """(table_name, n_rows): of two specs' versions what neither the second spec nor a run of it uses."""
    first, second = spec_of(spark, sf), spec_of(spark, sf, 3)
    second["paths"]["runs_root"] += "-of-the-second"
    a, b = pipeline.build(spark, first), pipeline.build(spark, second)
    with Run(spark, second) as r:
        r.note(dataset_tables=b)
    mine = {(v["table_name"], v["config_hash"]): v["n_rows"] for v in pipeline.store_of(spark, first).versions()}
    free = [x for x in pipeline.unused(spark, second) if x in a.items()]
    return spark.createDataFrame([(t, mine[t, h]) for t, h in free], "table_name string, n_rows long")


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """(status, backtest, fold, predictions, metrics): a whole run, read back from its folder."""
    r = pipeline.run(spark, spec_of(spark, sf))
    meta, metrics = r.meta(), r.metrics()
    p = spark.read.parquet(r.path("predictions.parquet")).groupBy("fold").agg(F.count("score").alias("predictions"))
    names = F.create_map(*[F.lit(x) for f in ("fold_1", "fold_2", "fold_3", "fold_4") for x in (f, json.dumps(sorted(k.split("/")[-1] for k in metrics if k.startswith(f + "/"))))])
    return p.select(F.lit(meta["status"]).alias("status"), F.lit(meta["backtest"]).alias("backtest"), "fold", "predictions", names[F.col("fold")].alias("metrics"))


QUERIES: dict[str, q.Query] = {f.__name__: f for f in (stored_versions, stored_features, stored_labels, stored_universe, stored_market, unused_versions, run_summary)}

_LAB = s.label(5, 0)
SQL: dict[str, str] = {
    "stored_versions": s.w(
        f"""SELECT table_name, n_rows, strftime(a, '%Y-%m-%d') AS min_date, strftime(z, '%Y-%m-%d') AS max_date FROM (
  SELECT 'features' AS table_name, count(*) AS n_rows, min(date) AS a, max(date) AS z FROM panel WHERE date BETWEEN DATE '{q.START}' - {WARMUP} AND DATE '{q.END}'
  UNION ALL SELECT 'market', count(DISTINCT date), min(date), max(date) FROM panel WHERE date BETWEEN DATE '{q.START}' - {WARMUP} AND DATE '{q.END}'
  UNION ALL SELECT 'universe', count(*), min(refresh_date), max(refresh_date) FROM uni UNION ALL SELECT 'labels', count(*), min(date), max(date) FROM lab)""",
        s.universe() + _LAB,
        True,
    ),
    "stored_features": s.w("SELECT date, security_id, " + ", ".join(s.r(f"{n}::FLOAT::DOUBLE", n, 4) for n in q.NAMES) + f" FROM feat WHERE date BETWEEN DATE '{q.START}' AND DATE '{q.END}'", s.FEAT),
    "stored_labels": s.SQL["label_forward_return"],
    "stored_universe": s.SQL["universe_topk"],
    "stored_market": s.w(f"SELECT date, {s.r('avg(lr)', 'ts__equal_weight_return')}, {s.r('avg(CASE WHEN ret_total IS NOT NULL THEN (ret_total > 0)::INT END)', 'static__breadth')}, {s.r('avg(lr)', 'ts__again')} FROM px WHERE date {s.PERIOD} GROUP BY date"),
    "unused_versions": s.w("SELECT 'labels' AS table_name, count(*) AS n_rows FROM lab", _LAB),
    "run_summary": s.w("SELECT 'finished' AS status, 'skipped' AS backtest, fold, count(*) AS predictions, '[\"decile_spread\", \"mean_ic\"]' AS metrics FROM mtest GROUP BY fold", s.MODEL_TEST, True),
}
