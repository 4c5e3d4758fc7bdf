"""Specs, the registry, stored versions and whole runs."""

import datetime as dt
import json
import logging

import numpy as np
import pytest
import yaml

from rankloom import cli, registry
from rankloom.operators.rolling import RollingStore, rolling_totals, series
from rankloom.operators.models import Fitted
from rankloom.plans import pipeline
from rankloom.plans.fingerprint import relevant, table_hashes
from rankloom.plans.runs import Run
from rankloom.plans.spec import load, parse
from rankloom.sources.store import TableStore, version_name
from rankloom.streaming.daily import daily_bars, keep_rolling

FIRST = dt.date(2021, 3, 1)
SESSIONS = [FIRST + dt.timedelta(days=n) for n in range(420) if (FIRST + dt.timedelta(days=n)).isoweekday() < 6]
K = 9
# which sessions of some names are absent: the start, the end, or a stretch
ABSENT = {501: range(0, 140), 507: range(230, 300), 512: range(90, 97)}


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    """Closes of 16 names as slow waves of their own with noise; volumes order the names, and some change places over time."""
    noise = np.random.default_rng(2021)
    n = np.arange(len(SESSIONS))
    rows = []
    for name in range(500, 516):
        close = 20 + name % 7 + 3 * np.sin(n / (9 + name % 5)) + noise.normal(0, 0.2, len(n))
        units = 1000.0 * (name - 480) * (1 + 0.5 * np.cos(n / 40 + name)) + noise.integers(0, 50, len(n))
        before = None
        for i in n:
            if i in ABSENT.get(name, ()):
                continue
            c = float(close[i])
            rows.append((name, SESSIONS[i], c - 0.1, c + 0.3, c - 0.3, c, float(units[i]), c, None if before is None else c / before - 1))
            before = c
    path = str(tmp_path_factory.mktemp("bars") / "panel")
    spark.createDataFrame(rows, "security_id long, date date, open double, high double, low double, close double, volume double, adj_close double, ret_total double").repartition(2).write.parquet(path)
    return path


@pytest.fixture
def spec_data(bars, tmp_path):
    return {
        "name": "waves",
        "paths": {"warehouse": bars, "data_root": str(tmp_path / "data"), "runs_root": str(tmp_path / "runs")},
        "data_spec": {"dataset_name": "waves", "source": {"func": "parquet_panel"}, "period": {"start": "2021-06-01", "end": "2022-02-25"}, "warmup_days": 75},
        "feature_spec": [{"func": "log_ret"}, {"func": "vol", "kwargs": {"n": 8}}, {"func": "dist_sma", "kwargs": {"n": 6}}],
        "filter_spec": {"func": "topk_dollar_volume", "kwargs": {"k": K, "buffer_ratio": 0.34, "x": 7, "y": 14, "ttl": 15}},
        "indicator_spec": [{"func": "breadth"}],
        "label_spec": {"func": "forward_return", "kwargs": {"h": 4}},
        "window_spec": {"lookback": 5, "max_missing": 1, "transforms": [{"func": "cs_zscore"}, {"func": "clip", "kwargs": {"lo": -2, "hi": 2}}]},
        "model_spec": {"func": "window_ridge", "kwargs": {"penalties": [0.01, 1.0]}},
        "loss_spec": {"func": "squared_error"},
        "split_spec": {"func": "purged_walk_forward", "kwargs": {"n_folds": 3, "purge": 4, "embargo": 3, "val_frac": 0.25}},
        "train_spec": {"min_valid_slots": 4},
        "evaluation_spec": {"metrics": [{"func": "mean_ic", "kwargs": {"min_stocks": 4}}, {"func": "decile_spread", "kwargs": {"n": 2, "min_stocks": 4}}]},
    }


def test_a_whole_run_leaves_all_its_files(spark, spec_data):
    r = pipeline.run(spark, parse(spec_data))
    meta = r.meta()
    assert meta["status"] == "finished" and meta["backtest"] == "skipped" and set(meta["dataset_tables"]) == {"features", "universe", "market", "labels"}
    assert {"test/mean_ic", "fold_1/test/mean_ic", "fold_3/test/decile_spread"} <= set(r.metrics())
    p = spark.read.parquet(r.path("predictions.parquet"))
    assert p.columns == ["date", "security_id", "slot", "score", "fold"] and p.where("score is null").count() == 0
    assert spark.read.parquet(r.path("metrics_per_date.parquet")).columns == ["date", "mean_ic", "decile_spread"]
    assert "built features" in r.files.read_text(r.path("run.log")) and yaml.safe_load(r.files.read_text(r.path("config.resolved.yaml")))["seed"] == 42
    fitted = Fitted.load(spark, r.path("model"))
    assert fitted.kind == "window_ridge" and sorted(fitted.folds) == ["fold_1", "fold_2", "fold_3"] and fitted.training["seed"] == 42
    again = parse({**spec_data, "backtest_spec": {"func": "long_short", "kwargs": {"top_k": 3}}})
    pipeline.run(spark, again, ("evaluate", "backtest"), r.folder)
    assert r.meta()["backtest"] == "done" and r.meta()["dataset_tables"] == meta["dataset_tables"] and "backtest/sharpe" in r.metrics()
    assert spark.read.parquet(r.path("backtest_nav.parquet")).count() > 5


def test_only_changed_tables_are_built_again_and_unused_ones_found(spark, spec_data):
    spec = parse(spec_data)
    first = pipeline.build(spark, spec)
    store = pipeline.store_of(spark, spec)
    times = {(v["table_name"], v["config_hash"]): v["built_at"] for v in store.versions()}
    changed = parse({**spec_data, "label_spec": {"func": "forward_return", "kwargs": {"h": 2}}})
    second = pipeline.build(spark, changed)
    assert {t for t in first if first[t] != second[t]} == {"labels"}
    now = {(v["table_name"], v["config_hash"]): v["built_at"] for v in store.versions()}
    assert len(now) == 5 and all(now[k] == t for k, t in times.items())
    assert pipeline.unused(spark, changed) == [("labels", first["labels"])]
    with pytest.raises(FileNotFoundError, match="which versions runs still use"):
        pipeline.unused(spark, changed, drop=True)
    with Run(spark, spec) as r:
        r.note(dataset_tables=first)
    assert pipeline.unused(spark, changed) == []
    # without the source's files the versions that this spec would read are kept too
    gone = parse({**spec_data, "paths": {**spec_data["paths"], "warehouse": "/nowhere", "runs_root": str(r.folder) + "-other"}})
    assert pipeline.unused(spark, gone) == [("labels", second["labels"])]
    r.note(dataset_tables=second)
    pipeline.unused(spark, changed, drop=True)
    assert not store.has("labels", first["labels"]) and store.has("labels", second["labels"])
    u = store.read("universe", first["universe"])
    assert u.groupBy("refresh_date").count().where(f"count != {K}").count() == 0
    gone = parse({**changed, "data_spec": spec_data["data_spec"], "paths": {**spec_data["paths"], "warehouse": "/nowhere"}})
    assert pipeline.build(spark, gone)["features"] == first["features"]
    with pytest.raises(FileNotFoundError):
        pipeline.build(spark, gone, force=True)
    w = pipeline.load_window(spark, changed, second, dt.date(2021, 9, 14))
    assert w.count() == K * 5
    with pytest.raises(ValueError):
        pipeline.load_window(spark, changed, second, dt.date(2021, 9, 12))


def test_features_from_the_decision_day_on_do_not_matter(spark, spec_data, tmp_path):
    from pyspark.sql import functions as F

    spec = parse(spec_data)
    p = spark.read.parquet(spec["paths"]["warehouse"])
    d = dt.date(2021, 9, 14)
    late = F.col("date") >= F.lit(str(d)).cast("date")
    other = str(tmp_path / "tampered")
    p.withColumns({c: F.when(late, F.lit(1.0)).otherwise(F.col(c)) for c in ("close", "adj_close", "ret_total")}).write.parquet(other)
    bent = parse({**spec_data, "paths": {**spec_data["paths"], "warehouse": other, "data_root": str(tmp_path / "d2")}})
    rows = lambda s: sorted(map(str, pipeline.load_window(spark, s, pipeline.build(spark, s), d).collect()))
    assert rows(spec) == rows(bent)


def test_the_settings_of_training_act(spark, spec_data):
    given = {"func": "set_ranker", "kwargs": {"hidden": 6}}
    train = {"min_valid_slots": 4, "max_epochs": 2, "lr": 0.01, "batch_dates": 8, "num_workers": 2, "monitor": "val_loss", "lr_patience": 1, "early_stopping_patience": 1}
    spec = parse({**spec_data, "seed": 7, "model_spec": given, "loss_spec": {"func": "hybrid_hinge", "kwargs": {"margin": 0.2}}, "train_spec": train})
    t = pipeline.training(spec)
    assert (t.loss, t.loss_args, t.seed, t.max_epochs, t.shards, t.monitor) == ("hybrid_hinge", {"margin": 0.2}, 7, 2, 2, "val_loss")
    r = pipeline.run(spark, spec, ("build", "train"))
    a = spark.read.parquet(r.path("predictions.parquet"))
    other = pipeline.run(spark, parse({**spec, "seed": 8}), ("build", "train"))
    b = spark.read.parquet(other.path("predictions.parquet"))
    both = a.join(b.withColumnRenamed("score", "other"), ["date", "security_id", "slot", "fold"])
    assert a.count() == both.count() > 0 and both.where("abs(score - other) > 1e-9").count() > 0
    assert Fitted.load(spark, r.path("model")).training["seed"] == 7


def test_failed_runs_say_so_and_metrics_are_numbers(spark, spec_data):
    spec = parse(spec_data)
    with pytest.raises(RuntimeError), Run(spark, spec) as r:
        raise RuntimeError("no")
    assert r.meta()["status"] == "failed" and Run(spark, spec).folder != Run(spark, spec).folder
    for bad in (True, "1"):
        with pytest.raises(TypeError):
            r.record({"x": bad})
    r.record({"x": 1, "none": None}, "p")
    assert r.metrics() == {"p/x": 1.0}
    with pytest.raises(ValueError):
        pipeline.run(spark, spec, ("sing",))


def test_store_names_and_replacement(spark, tmp_path):
    for bad in (("features", "xyz"), ("other", "abcdef"), ("features", "../abcdef")):
        with pytest.raises(ValueError):
            version_name(*bad)
    s = TableStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(FIRST, 1, 0.5)], "date date, security_id long, label double")
    s.write("labels", df, "abc123", {})
    e = s.write("labels", df.union(df), "abc123", {"a": 1})
    assert e["n_rows"] == 2 and e["min_date"] == "2021-03-01" and len(s.versions()) == 1 and s.read("labels", "abc123", "security_id = 1").count() == 2
    s.files.claim(f"{s.root}/_locks/labels__abc123")
    with pytest.raises(RuntimeError, match="being written by another"):
        s.write("labels", df, "abc123", {})
    s.files.remove(f"{s.root}/_locks/labels__abc123")
    s.drop("labels", "abc123")
    assert s.versions("labels") == []
    with pytest.raises(FileNotFoundError):
        s.read("labels", "abc123")


# ---------------------------------------------------------------- specs


@pytest.mark.parametrize(
    "change, says",
    [
        ({"extra": 1}, "extra is not known"),
        ({"window_spec": {"lookback": 0}}, "lookback must be above 0"),
        ({"window_spec": {"fill": "mean"}}, "fill must be one of"),
        ({"train_spec": {"min_valid_slots": 1}}, "2 or more"),
        ({"filter_spec": {"func": "nope"}}, "no filter 'nope'"),
        ({"feature_spec": [{"func": "vol", "args": {}}]}, "component is"),
        ({"label_spec": None}, "label_spec is missing"),
        ({"name": 5}, "wrong type"),
        ({"loss_spec": {"func": "hybrid_hinge"}}, "can't be trained by hybrid_hinge"),
        ({"train_spec": {"accelerator": "gpu"}}, "accelerator must be one of"),
        ({"train_spec": {"deterministic": False}}, "always reproducible"),
        ({"tracking_spec": {"wandb": {"enabled": True}}}, "can't be enabled"),
    ],
)
def test_spec_errors_are_collected(spec_data, change, says):
    with pytest.raises(ValueError, match=says):
        parse({**spec_data, **change})


def test_period_must_be_ordered(spec_data):
    spec_data["data_spec"]["period"] = {"start": "2020-01-01", "end": "2019-01-01"}
    with pytest.raises(ValueError, match="after its start"):
        parse(spec_data)


def test_environment_and_times(spec_data, tmp_path, caplog):
    (tmp_path / "pyproject.toml").write_text("")
    (tmp_path / "configs/env").mkdir(parents=True)
    (tmp_path / "configs/env/local.yaml").write_text("paths: {warehouse: bars, data_root: /data, runs_root: runs}")
    (tmp_path / "configs/env/bad.yaml").write_text("seed: 1")
    del spec_data["paths"]
    f = tmp_path / "configs" / "a.yaml"
    f.write_text(yaml.safe_dump(spec_data))
    with caplog.at_level(logging.WARNING):
        s = load(f, "local", {"start": dt.date(2021, 7, 1), "end": None})
    assert s.start == dt.date(2021, 7, 1) and "replaces 2021-06-01" in caplog.text
    assert s["paths"] == {"warehouse": str(tmp_path / "bars"), "data_root": "/data", "runs_root": str(tmp_path / "runs")}
    for env, error in (("bad", ValueError), ("none", FileNotFoundError)):
        with pytest.raises(error):
            load(f, env)
    with pytest.raises(ValueError):
        load(f, "local", {"seed": FIRST})


def test_short_purge_warns(spec_data, caplog):
    with caplog.at_level(logging.WARNING):
        parse({**spec_data, "split_spec": {"func": "purged_walk_forward", "kwargs": {"purge": 2}}})
    assert "shorter than the label's horizon" in caplog.text


def test_registry():
    assert "topk_dollar_volume" in registry.names("filter")
    with pytest.raises(KeyError, match="known: .*equal_weight_return"):
        registry.get("indicator", "nope")
    with pytest.raises(ValueError):
        registry.register("colour", "red")
    registry.register("loss", "only_here")(lambda: 1)
    with pytest.raises(ValueError, match="twice"):
        registry.register("loss", "only_here")(test_registry)
    del registry._known["loss"]["only_here"]


CODE = '''"""doc"""
N = 3
@register("feature", "a")
def a():
    """says"""
    return helper(N)  # why
@register("feature", "b")
def b():
    return 2
def helper(x):
    return x
'''


def test_fingerprint_ignores_comments_and_other_components():
    base = relevant(CODE, "a")
    assert base == relevant(CODE.replace("# why", "# other").replace('"""says"""', '"""else"""').replace("return 2", "return 5"), "a")
    assert base != relevant(CODE.replace("return x", "return x + 1"), "a") and base != relevant(CODE.replace("N = 3", "N = 4"), "a")


def test_hashes_follow_the_source_files(spark, spec_data, tmp_path):
    from rankloom.sources.files import Files

    spec = parse(spec_data)
    other = parse({**spec_data, "paths": {**spec_data["paths"], "warehouse": str(tmp_path)}})
    a, b = table_hashes(spec, Files(spark)), table_hashes(other, Files(spark))
    assert all(a[t] != b[t] for t in a)


def test_command_line(spec_data, tmp_path, capsys):
    assert cli.main(["components"]) == 0
    assert "window_ridge" in capsys.readouterr().out
    f = tmp_path / "a.yaml"
    f.write_text(yaml.safe_dump(json.loads(json.dumps(spec_data))))
    assert cli.main(["validate", str(f)]) == 0
    assert "lookback: 5" in capsys.readouterr().out


# ---------------------------------------------------------------- streams


def test_streams_of_readings(spark, tmp_path):
    schema = "user long, at timestamp, day date, v double"
    src = str(tmp_path / "in")
    t = lambda d, h: dt.datetime(2020, 1, d, h)
    put = lambda rows: spark.createDataFrame([(u, x, x.date(), v) for u, x, v in rows], schema).write.mode("append").parquet(src)
    put([(1, t(1, 3), 1.0), (1, t(1, 9), 2.0), (2, t(1, 5), 5.0)])
    q = daily_bars(spark.readStream.schema(schema).parquet(src), "user", "at", "v").writeStream.format("memory").queryName("bars").outputMode("append").start()
    q.processAllAvailable()
    put([(1, t(4, 1), 7.0)])
    q.processAllAvailable()
    put([(1, t(1, 4), 100.0), (1, t(6, 1), 1.0)])  # the first is too late
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select user, n, total, low, high from bars").collect())
    assert got[:3] == [(1, 1, 7.0, 7.0, 7.0), (1, 2, 3.0, 1.0, 2.0), (2, 1, 5.0, 5.0, 5.0)]


def test_stream_keeps_rolling_state(spark, tmp_path):
    schema = "user long, day date, v double"
    src = str(tmp_path / "in")
    rows = [[(1, dt.date(2020, 1, d), float(d)) for d in (1, 2, 9)], [(1, dt.date(2020, 1, 3), 0.5), (2, dt.date(2020, 1, 5), 1.0)]]
    store = RollingStore(spark, str(tmp_path / "state"))
    for part in rows:
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        q = keep_rolling(spark.readStream.schema(schema).parquet(src), store, "user", "day", "v", str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    key = lambda df: sorted(map(str, df.collect()))
    assert store.versions() == [1, 2]
    assert key(series(store.current(), "user")) == key(rolling_totals(spark.createDataFrame(sum(rows, []), schema), "user", "day", "v"))
