"""Ranking models on window summaries, fitted per walk-forward fold.

All folds are fitted together: which days belong to which segment of which fold is a small table on the driver, and each
pass over the rows serves every fold.  A fitted model is a plain value (kind, inputs, parameters per fold) that is saved with the run and scores later.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import losses, ranker
from rankloom.operators.splits import PurgedWalkForward
from rankloom.registry import register
from rankloom.session import written

_DAY_0 = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class Training:
    """How to fit: the spec's train_spec, seed and loss."""

    loss: str = "squared_error"
    loss_args: dict = field(default_factory=dict)
    seed: int = 42
    max_epochs: int = 15
    batch_dates: int = 32
    lr: float = 1e-3
    weight_decay: float = 1e-5
    lr_patience: int = 3
    lr_factor: float = 0.5
    monitor: str = "val_ic"
    early_stopping_patience: int | None = None
    min_valid_slots: int = 20
    shards: int = 8  # parts of the days that descend side by side; their parameters are averaged after each epoch


@dataclass
class Fitted:
    """A fitted model: per fold named arrays of parameters, or, for trees, their MLlib models."""

    kind: str
    inputs: list[str]
    folds: dict[str, dict[str, Any]]
    training: dict[str, Any] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        from rankloom.sources.files import Files

        plain = {}
        for name, p in self.folds.items():
            if "trees" in p:
                p["trees"].write().overwrite().save(f"{path}/{name}")
                p = {k: v for k, v in p.items() if k != "trees"}
            plain[name] = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in p.items()}
        Files(spark).write_text(f"{path}/model.json", json.dumps({"kind": self.kind, "inputs": self.inputs, "folds": plain, "training": self.training}))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        from rankloom.sources.files import Files

        data = Files(spark).read_json(f"{path}/model.json")
        folds = {n: {k: np.array(v) if isinstance(v, list) else v for k, v in p.items()} for n, p in data["folds"].items()}
        if data["kind"] == "window_trees":
            for n in folds:
                folds[n]["trees"] = GBTRegressionModel.load(f"{path}/{n}")
        return Fitted(data["kind"], data["inputs"], folds, data["training"])

    def score(self, rows: DataFrame, fold: str | None = None) -> DataFrame:
        """(date, security_id, slot, score, fold) of summarised windows, whose column ``fold`` (or the one given, else the last) names the parameters."""
        if fold is not None or "fold" not in rows.columns:
            rows = rows.withColumn("fold", F.lit(fold or list(self.folds)[-1]))
        return _SCORERS[self.kind](self, rows).select("date", "security_id", "slot", "score", "fold")


def summaries(windows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(date, slot, security_id, x columns): of each real slot's window the last value, mean and standard deviation per feature."""
    per = windows.where("real").groupBy("date", "slot", "security_id")
    cols = [c for n in names for c in (F.max_by(n, "lag").alias(f"{n}__last"), F.avg(n).alias(f"{n}__mean"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias(f"{n}__sd"))]
    return per.agg(*cols)


Segments = dict[str, dict[str, set]]  # per fold: days (since 1970) of fit, judge, train, val and test


def segments(days: Sequence[int], enough: set, splitter: PurgedWalkForward, search: str = "val", inner: float = 0.7, gap: int = 5) -> Segments:
    """Days per fold.  Candidates are fitted on ``fit`` and held against each other on ``judge``, the winner is fitted on ``train``.

    With search 'val' these are the training and validation days; with 'inner' a purged split of the training days alone:
    their first ``inner`` share, and what follows ``gap`` days later.  Training days need ``enough`` labels.
    """
    if search not in ("val", "inner"):
        raise ValueError("search must be 'val' or 'inner'")
    out: Segments = {}
    for f in splitter.folds(len(days)):
        part = lambda s: list(days[slice(*getattr(f, s))])  # noqa: B023, E731
        train, val, test = part("train"), part("val"), part("test")
        fit, judge = train, val
        if search == "inner":
            cut = int(len(train) * inner)
            fit, judge = train[:cut], train[cut + gap :]
            if not fit or not judge:
                raise ValueError(f"{f.name}: {len(train)} training days give no inner split")
        out[f.name] = {"fit": set(fit) & enough, "judge": set(judge), "train": set(train) & enough, "val": set(val), "test": set(test)}
    return out


def _in_segment(rows: DataFrame, where: Segments, segment: str) -> DataFrame:
    """The rows of a segment with their fold; one row a day and fold is broadcast."""
    table = rows.sparkSession.createDataFrame([(d, name) for name, s in where.items() for d in sorted(s[segment])], "day int, fold string")
    return rows.withColumn("day", F.unix_date("date")).join(F.broadcast(table), "day").drop("day")


def _better(a: float, b: float | None, monitor: str) -> bool:
    return b is None or (a > b if monitor == "val_ic" else a < b)


def _judged(rows: DataFrame, by: Sequence[str], t: Training) -> dict[tuple, float]:
    """The monitored value per group: one row each."""
    if t.monitor == "val_ic":
        got = losses.validation_ic(rows, by)
    else:
        from rankloom import registry

        scored = rows.withColumn("date", F.struct(*by, "date")) if by else rows
        got = registry.get("loss", t.loss)(scored, **t.loss_args).groupBy(*[F.col(f"date.{b}").alias(b) for b in by]).agg(F.avg("loss").alias("value"))
    return {tuple(r[b] for b in by): r["value"] for r in got.collect()}


# ---------------------------------------------------------------- linear


def _moments(rows: DataFrame, inputs: Sequence[str], where: Segments, which: Sequence[str]) -> dict[tuple[str, str], np.ndarray]:
    """Per fold and segment the products of (1, x, y) summed over its labelled rows, for all of them in one pass."""
    names = [(f, s) for f in where for s in which]
    days = [np.array(sorted(where[f][s]), np.int64) for f, s in names]
    size = len(inputs) + 2

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), size, size))
        for b in batches:
            if b.num_rows:
                m = np.column_stack([np.ones(b.num_rows), *[b[c].to_numpy(zero_copy_only=False) for c in (*inputs, "label")]])
                day = b["day"].to_numpy()
                for n, d in enumerate(days):
                    part = m[np.isin(day, d)]
                    total[n] += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

    got = rows.where("label is not null").select(F.unix_date("date").alias("day"), *inputs, "label").mapInArrow(gather, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(names) * size * size)
    for at, v in got:
        flat[at] = v
    return dict(zip(names, flat.reshape(-1, size, size)))


def _ridge(m: np.ndarray, penalty: float) -> np.ndarray:
    """(intercept, weights) that minimise the mean squared error plus penalty times the squared weights."""
    n = max(m[0, 0], 1.0)
    a = m[:-1, :-1] / n + np.diag([0.0, *[penalty] * (len(m) - 2)])
    return np.linalg.lstsq(a, m[:-1, -1] / n, rcond=None)[0]


def _linear(w: np.ndarray, inputs: Sequence[str]):
    out = F.lit(float(w[0]))
    for c, x in zip(inputs, w[1:]):
        out = out + F.col(c) * F.lit(float(x))
    return out


def _by_fold(folds: dict[str, Any], value) -> Any:
    out = F.lit(None).cast("double")
    for name, p in folds.items():
        out = F.when(F.col("fold") == name, value(p)).otherwise(out)
    return out


@register("model", "window_ridge")
class WindowRidge:
    """Least squares with a penalty: one pass for the moments of all folds, one to judge all penalties of all folds."""

    losses = ("squared_error",)

    def __init__(self, penalties: Sequence[float] = (0.001, 0.1), penalty: float | None = None, search: str = "val", **dims):
        self.penalties = (penalty,) if penalty is not None else tuple(penalties)
        self.search = search

    def fit(self, rows: DataFrame, inputs: list[str], where: Segments, t: Training) -> Fitted:
        m = _moments(rows, inputs, where, ("fit", "train"))
        tried = {name: [_ridge(m[name, "fit"], p) for p in self.penalties] for name in where}
        got: dict[tuple, float] = {}
        if len(self.penalties) > 1:
            judged = _in_segment(rows, where, "judge").where("label is not null")
            each = F.array(*[F.struct(F.lit(n).alias("candidate"), _by_fold(tried, lambda w, n=n: _linear(w[n], inputs)).alias("score")) for n in range(len(self.penalties))])
            long = judged.select("fold", "date", "security_id", "label", F.explode(each).alias("e")).select("fold", "date", "security_id", "label", "e.candidate", "e.score")
            got = _judged(long, ["fold", "candidate"], t)
        folds = {}
        for name in where:
            best = 0
            for n in range(1, len(self.penalties)):
                if _better(got.get((name, n), -np.inf if t.monitor == "val_ic" else np.inf), got.get((name, best)), t.monitor):
                    best = n
            folds[name] = {"weights": _ridge(m[name, "train"], self.penalties[best]), "penalty": self.penalties[best]}
        return Fitted("window_ridge", inputs, folds)


# ---------------------------------------------------------------- trees


@register("model", "window_trees")
class WindowTrees:
    """Boosted trees of MLlib, one fit per fold; seeded by the spec."""

    losses = ("squared_error",)

    def __init__(self, depth: int = 5, rounds: int = 100, **dims):
        self.depth, self.rounds = depth, rounds

    def fit(self, rows: DataFrame, inputs: list[str], where: Segments, t: Training) -> Fitted:
        x = VectorAssembler(inputCols=inputs, outputCol="x")
        train = x.transform(_in_segment(rows, where, "train").where("label is not null")).select("fold", "x", F.col("label").alias("y"))
        fit = tree_regressor(self.depth, self.rounds, t.seed).fit
        return Fitted("window_trees", inputs, {name: {"trees": fit(train.where(F.col("fold") == name))} for name in where})


def tree_regressor(depth: int = 5, rounds: int = 100, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(featuresCol="x", labelCol="y", predictionCol="score", maxDepth=depth, maxIter=rounds, seed=seed)


# ---------------------------------------------------------------- set ranker


def _days(rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """(fold?, day, date, names): one row a day with its names, at most as many as the universe has slots."""
    keys = [c for c in ("fold", "date") if c in rows.columns]
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("double")
    one = F.struct("slot", "security_id", F.array(*[F.col(c).cast("double") for c in inputs]).alias("x"), label.cast("double").alias("y"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("names")).withColumn("day", F.unix_date("date"))


def _names_of(b: pa.RecordBatch, width: int) -> Iterator[tuple[int, pa.StructArray, np.ndarray, np.ndarray]]:
    """(row, names, inputs, labels) for each day of a batch."""
    for n in range(b.num_rows):
        names = b["names"][n].values
        x = names.field("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(names), width)
        y = np.asarray(names.field("y").to_numpy(zero_copy_only=False), float)
        yield n, names, np.nan_to_num(x), y


@register("model", "set_ranker")
class SetRanker:
    """Scores each name in view of the day's other names; trained by descents side by side on parts of the days, averaged after every epoch.

    One Spark job per epoch serves all folds: each task takes its part of the days, descends for every fold over its training days in
    an order drawn from (seed, epoch), and judges the parameters it was given on its validation days.
    """

    losses = tuple(ranker.LOSSES)

    def __init__(self, hidden: int | Sequence[int] = 32, **dims):
        self.hidden = (hidden,) if isinstance(hidden, int) else tuple(hidden)

    def fit(self, rows: DataFrame, inputs: list[str], where: Segments, t: Training) -> Fitted:
        """Of several widths the one that is best on the fold's validation days."""
        tried = [self._fit(rows, inputs, where, t, h) for h in self.hidden]
        out = tried[0]
        for other in tried[1:]:
            for name in where:
                if _better(other.training["monitored"][name], out.training["monitored"][name], t.monitor):
                    out.folds[name], out.training["monitored"][name] = other.folds[name], other.training["monitored"][name]
        return out

    def _fit(self, rows: DataFrame, inputs: list[str], where: Segments, t: Training, hidden: int) -> Fitted:
        loss = partial(ranker.LOSSES[t.loss], **t.loss_args)
        width = len(inputs)
        days = written(_days(rows, inputs).select("day", "names").withColumn("shard", F.pmod(F.xxhash64(F.lit(t.seed), "day"), F.lit(t.shards)).cast("int")), "ranker-days")
        used = days.repartition(t.shards, "shard").sortWithinPartitions("shard", "day")
        now = {name: ranker.start(width, hidden, t.seed) for name in where}
        rate = {name: t.lr for name in where}
        best: dict[str, tuple[float, dict]] = {}
        worse = dict.fromkeys(where, 0)
        live = set(where)
        for epoch in range(t.max_epochs + 1):
            given = {name: (now[name], rate[name]) for name in live}
            last = epoch == t.max_epochs  # judges only

            def work(batches: Iterator[pa.RecordBatch], given=given, epoch=epoch, last=last) -> Iterator[pa.RecordBatch]:
                shards: dict[int, list] = {}
                for b in batches:
                    shard, day = b["shard"].to_numpy(), b["day"].to_numpy()
                    for n, _, x, y in _names_of(b, width):
                        if np.isfinite(y).sum() >= 2:
                            shards.setdefault(int(shard[n]), []).append((int(day[n]), x, y))
                out: list[list] = [[] for _ in range(6)]
                for number, mine in sorted(shards.items()):
                    mixed = [mine[i] for i in np.random.default_rng([t.seed, epoch, number]).permutation(len(mine))]
                    for name, (p, r) in given.items():
                        train = [] if last else [(x, y) for d, x, y in mixed if d in where[name]["train"]]
                        seen = [v for d, x, y in mine if d in where[name]["val"] for v in [ranker.judged(p, x, y, loss)]]
                        after, _ = ranker.descend(p, train, loss, r, t.weight_decay, t.batch_dates)
                        ic = [v[0] for v in seen if np.isfinite(v[0])]
                        flat = np.concatenate([after[k].ravel() for k in sorted(after)]) * len(train)
                        for o, v in zip(out, (name, float(len(train)), flat.tolist(), float(sum(ic)), float(len(ic)), [float(sum(v[1] for v in seen)), float(len(seen))])):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.float64())), pa.array(out[3], pa.float64()), pa.array(out[4], pa.float64()), pa.array(out[5], pa.list_(pa.float64()))], names=["fold", "n", "p", "ic", "days", "loss"])

            got = used.mapInArrow(work, "fold string, n double, p array<double>, ic double, days double, loss array<double>").collect()  # shards x folds rows
            for name in sorted(live):
                part = sorted((r for r in got if r["fold"] == name), key=lambda r: (r["n"], r["p"]))
                weight, ics, judged = sum(r["n"] for r in part), sum(r["days"] for r in part), sum(r["loss"][1] for r in part)
                value = (sum(r["ic"] for r in part) / ics if ics else 0.0) if t.monitor == "val_ic" else (sum(r["loss"][0] for r in part) / judged if judged else 0.0)
                if _better(value, best[name][0] if name in best else None, t.monitor):
                    best[name], worse[name] = (value, now[name]), 0
                else:
                    worse[name] += 1
                    if worse[name] % max(t.lr_patience, 1) == 0:
                        rate[name] *= t.lr_factor
                if last or not weight or (t.early_stopping_patience is not None and worse[name] >= t.early_stopping_patience):
                    live.discard(name)
                    continue
                flat, at, new = np.sum([r["p"] for r in part], axis=0) / weight, 0, {}
                for k in sorted(now[name]):
                    new[k] = flat[at : at + now[name][k].size].reshape(now[name][k].shape)
                    at += now[name][k].size
                now[name] = new
            if not live:
                break
        return Fitted("set_ranker", inputs, {name: dict(best[name][1]) for name in where}, {"monitored": {name: best[name][0] for name in where}})


def _score_sets(f: Fitted, rows: DataFrame) -> DataFrame:
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b["fold"].to_pylist()
            for n, names, x, _ in _names_of(b, len(f.inputs)):
                s = ranker.scores(f.folds[fold[n]], x)
                day = pa.array([b["date"][n].as_py()] * len(names), pa.date32())
                yield pa.RecordBatch.from_arrays([day, names.field("security_id"), names.field("slot"), pa.array(s), pa.array([fold[n]] * len(names))], names=["date", "security_id", "slot", "score", "fold"])

    return _days(rows, f.inputs).mapInArrow(give, "date date, security_id long, slot int, score double, fold string")


def _score_trees(f: Fitted, rows: DataFrame) -> DataFrame:
    x = VectorAssembler(inputCols=f.inputs, outputCol="x").transform(rows)
    parts = [p["trees"].transform(x.where(F.col("fold") == name)).select("date", "security_id", "slot", "score", "fold") for name, p in f.folds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SCORERS: dict[str, Callable[[Fitted, DataFrame], DataFrame]] = {
    "window_ridge": lambda f, rows: rows.withColumn("score", _by_fold(f.folds, lambda p: _linear(p["weights"], f.inputs))),
    "window_trees": _score_trees,
    "set_ranker": _score_sets,
}


def fit_folds(windows: DataFrame, names: Sequence[str], labels: DataFrame, splitter: PurgedWalkForward, model: Any = None, training: Training | None = None) -> tuple[DataFrame, Fitted]:
    """(predictions (date, security_id, slot, score, fold) of the test blocks, the fitted model).

    The table of summaries is written once.  Which days there are and how many labels they have is one row a day on the driver.
    """
    t, model = training or Training(), model or WindowRidge()
    if t.loss not in model.losses:
        raise ValueError(f"{type(model).__name__} can't be trained by {t.loss}; it takes {', '.join(model.losses)}")
    base = summaries(windows, names)
    inputs = [c for c in base.columns if "__" in c]
    data = written(base.join(labels.select("date", "security_id", F.col("label").cast("double").alias("label")), ["date", "security_id"], "left"), "model-rows")
    counts = {(r["date"] - _DAY_0).days: r["n"] for r in data.groupBy("date").agg(F.count("label").alias("n")).collect()}
    where = segments(sorted(counts), {d for d, n in counts.items() if n >= t.min_valid_slots}, splitter, getattr(model, "search", "val"))
    fitted = model.fit(data, inputs, where, t)
    fitted.training = {**asdict(t), **fitted.training}
    return fitted.score(_in_segment(data, where, "test")), fitted


def walk_forward(windows: DataFrame, names: Sequence[str], labels: DataFrame, splitter: PurgedWalkForward, model: Any = None, training: Training | None = None) -> DataFrame:
    """The predictions of ``fit_folds``."""
    return fit_folds(windows, names, labels, splitter, model, training)[0]


def attribution(rows: DataFrame, inputs: Sequence[str], weights: Sequence[float], regimes: DataFrame) -> DataFrame:
    """(regime, feature, attribution): mean absolute contribution weight * (value - mean) of each input of a linear model, for which integrated gradients are exact."""
    mean = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in inputs])
    j = rows.join(F.broadcast(regimes), "date").join(F.broadcast(mean))
    long = j.select("regime", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.lit(float(w)) * (F.col(c) - F.col(f"m_{c}"))).alias("a")) for c, w in zip(inputs, weights)])).alias("e"))
    return long.groupBy("regime", "e.feature").agg(F.avg("e.a").alias("attribution"))


def set_attribution(fitted: Fitted, rows: DataFrame, regimes: DataFrame, steps: int = 32) -> DataFrame:
    """(regime, feature, attribution): mean absolute integrated gradient of each input of a set ranker, from the inputs' zero to the day's values.

    The gradient of the sum of a day's scores is averaged over ``steps`` midpoints of the straight path; rows need the column ``fold``.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, regime = b["fold"].to_pylist(), b["regime"].to_pylist()
            for n, _, x, _ in _names_of(b, len(fitted.inputs)):
                p = fitted.folds[fold[n]]
                total = np.zeros_like(x)
                for a in (np.arange(steps) + 0.5) / steps:
                    total += ranker.input_slopes(p, a * x)
                g = np.abs(total / steps * x)
                yield pa.RecordBatch.from_arrays([pa.array([regime[n]] * len(fitted.inputs), pa.string()), pa.array(fitted.inputs), pa.array(g.sum(axis=0)), pa.array([len(x)] * len(fitted.inputs), pa.int64())], names=["regime", "feature", "s", "n"])

    days = _days(rows, fitted.inputs).join(F.broadcast(regimes.select("date", "regime")), "date")
    return days.mapInArrow(give, "regime string, feature string, s double, n long").groupBy("regime", "feature").agg((F.sum("s") / F.sum("n")).alias("attribution"))


def surrogate_fidelity(rows: DataFrame, inputs: Sequence[str], depth: int = 5, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(value): Spearman correlation of scores with those of a tree surrogate fitted to them."""
    from rankloom.functions.columns import average_rank, correlation

    x = VectorAssembler(inputCols=list(inputs), outputCol="x").transform(rows.withColumnRenamed("score", "y"))
    fitted = tree_regressor(depth, rounds, seed).fit(x).transform(x)
    per = fitted.select("date", average_rank(F.col("y"), ["date"]).alias("a"), average_rank(F.col("score"), ["date"]).alias("b")).groupBy("date").agg(correlation(F.col("a"), F.col("b")).alias("ic"))
    return per.agg(F.avg("ic").alias("value"))


def sample_days(df: DataFrame, days: int, names: int, seed: int = 42) -> DataFrame:
    """Rows of a reproducible sample of days and, on each, of names: those with the lowest hashes."""
    from pyspark.sql import Window as W

    few = df.select("date").distinct().orderBy(F.xxhash64(F.lit(seed), "date")).limit(days)
    r = F.row_number().over(W.partitionBy("date").orderBy(F.xxhash64(F.lit(seed), "date", "security_id")))
    return df.join(F.broadcast(few), "date", "left_semi").withColumn("_r", r).where(F.col("_r") <= names).drop("_r")
