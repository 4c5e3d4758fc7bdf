"""Filling missing numbers and words by EM for a mixture of Gaussians and categories.

A row's numbers enter as their distance from the mean of their group (a group is e.g. one
security), its words as they are.  A mixture of ``components`` classes, each with a full
Gaussian over the numbers and a distribution for each word field, is fitted by
expectation-maximisation to all rows, complete or not.  A pass over the data yields nothing
but sufficient statistics (class weights, first and second moments with the conditional
moments of missing numbers, word counts); they are summed by Spark, so what reaches the
driver has the size of the model.  The passes start from the fit to a sample of at most about ``sample`` rows, chosen by a hash, which the driver
brings to convergence first; so few passes over all rows are left to go to the tolerance.

A missing number becomes the group's mean plus the mixture's conditional expectation given
the row's other numbers, its helpers and words.  A missing word becomes the mode of its posterior: the
words' counts among the rows of the same group (or the same time) as prior, times what the
mixture says of the row.  Masks mark every filled cell.

Group and time statistics are sums, built with partial aggregation; a group with a third of
all rows is one row afterwards.  Of a group's words only those go to its rows that the fitted mixture can still make the mode, whatever the row.
The statistics are broadcast to the rows if their size, which is
counted first, is below BROADCAST_BYTES; else the rows are joined by key, where adaptive
execution splits a hot key.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import finite, written

# fixed values: notations of a missing word, after trimming and lower-casing
MISSING_WORDS = ("", "n/a", "na", "#n/a", "none", "null", "nil", "nan", "unknown", "?", "-", "--", ".")
BLANKS = " \t\n\r\x0b\x0c\u00a0\u200b\u2007\u202f\ufeff"
BROADCAST_BYTES = 48 << 20


@dataclass(frozen=True)
class Number:
    """A usable value v has low < v < high.  A positive, skewed field is modelled by its logarithm."""

    name: str
    low: float = 0.0
    high: float = float("inf")
    log: bool = False

    def usable(self) -> Column:
        v = finite(self.name)
        return F.when((v > self.low) & (v < self.high), v)

    def model(self) -> Column:
        v = self.usable()
        return F.ln(v) if self.log else v


@dataclass(frozen=True)
class Word:
    """``by`` is 'group' or 'time': whose rows tell the word.  ``missing`` are the notations of a missing one, trimmed and in lower case."""

    name: str
    by: str = "group"
    missing: Sequence[str] = MISSING_WORDS

    def usable(self) -> Column:
        v = F.lower(F.btrim(F.col(self.name), F.lit(BLANKS)))
        return F.when(~v.isin(*self.missing), v)


def patterns(z: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, observed fields, missing fields) for each set of missing fields among the rows."""
    seen = np.isfinite(z)
    key = seen @ (1 << np.arange(z.shape[1])) if z.shape[1] else np.zeros(len(z), int)
    out = []
    for q in np.unique(key):
        on = np.array([(q >> j) & 1 for j in range(z.shape[1])], bool)
        out.append((np.flatnonzero(key == q), np.flatnonzero(on), np.flatnonzero(~on)))
    return out


@dataclass
class Mixture:
    weight: np.ndarray  # K
    mean: np.ndarray  # K x p
    cov: np.ndarray  # K x p x p
    words: list[np.ndarray] = field(default_factory=list)  # per word field: K x levels

    def log_joint(self, z: np.ndarray, codes: Sequence[np.ndarray], groups: list | None = None) -> np.ndarray:
        """log p(class, observed cells) per row; NaN numbers and codes below 0 are not observed."""
        out = np.tile(np.log(self.weight), (len(z), 1))
        for rows, o, _ in groups if groups is not None else patterns(z):
            if not len(o):
                continue
            seen = z[np.ix_(rows, o)]
            for c in range(len(self.weight)):
                s = self.cov[c][np.ix_(o, o)]
                # rows become independent standard normal ones
                e = np.linalg.solve(np.linalg.cholesky(s), (seen - self.mean[c][o]).T)
                out[rows, c] -= 0.5 * ((e * e).sum(axis=0) + np.linalg.slogdet(s)[1] + len(o) * np.log(2 * np.pi))
        for w, code in zip(self.words, codes):
            out += np.concatenate([np.log(w.T), np.zeros((1, len(self.weight)))])[code]  # code -1 is the row of zeros
        return out

    def complete(self, z: np.ndarray, c: int, groups: list | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Numbers with the missing ones at their expectation in class c; (rows, covariance left in them) for each set of missing fields."""
        full, rest = z.copy(), []
        for rows, o, m in groups if groups is not None else patterns(z):
            if not len(m):
                continue
            s = self.cov[c]
            gain = s[np.ix_(m, o)] @ np.linalg.inv(s[np.ix_(o, o)]) if len(o) else np.zeros((len(m), 0))
            full[np.ix_(rows, m)] = self.mean[c][m] + (z[np.ix_(rows, o)] - self.mean[c][o]) @ gain.T
            left = np.zeros_like(s)
            left[np.ix_(m, m)] = s[np.ix_(m, m)] - gain @ s[np.ix_(o, m)]
            rest.append((rows, left))
        return full, rest

    def statistics(self, z: np.ndarray, codes: Sequence[np.ndarray]) -> np.ndarray:
        """Sufficient statistics of these rows as one vector: log likelihood, rows, then per class weight, sums, products and word counts."""
        groups = patterns(z)
        lj = self.log_joint(z, codes, groups)
        top = lj.max(axis=1, keepdims=True)
        r = np.exp(lj - top)
        total = r.sum(axis=1, keepdims=True)
        r /= total
        parts = [[float((np.log(total) + top).sum()), float(len(z))]]
        for c in range(len(self.weight)):
            full, rest = self.complete(z, c, groups)
            w = r[:, c]
            second = (full * w[:, None]).T @ full
            for rows, left in rest:
                second = second + w[rows].sum() * left
            parts += [[w.sum()], w @ full, second.ravel()]
            for words, code in zip(self.words, codes):
                parts.append(np.bincount(code + 1, w, minlength=words.shape[1] + 1)[1:])
        return np.concatenate([np.asarray(x, float).ravel() for x in parts])

    def maximised(self, s: np.ndarray) -> Mixture:
        p, k = self.mean.shape[1], len(self.weight)
        at, w, m, c, words = 2, [], [], [], [[] for _ in self.words]
        for _ in range(k):
            n = max(s[at], 1e-9)
            w.append(n)
            mu = s[at + 1 : at + 1 + p] / n
            at += 1 + p
            cov = s[at : at + p * p].reshape(p, p) / n - np.outer(mu, mu)
            at += p * p
            m.append(mu)
            c.append((cov + cov.T) / 2 + 1e-6 * np.eye(p))
            for i, x in enumerate(self.words):
                counts = s[at : at + x.shape[1]] + 0.5
                words[i].append(counts / counts.sum())
                at += x.shape[1]
        return Mixture(np.array(w) / sum(w), np.array(m), np.array(c), [np.array(x) for x in words])


def _matrix(t: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    cols = [np.asarray(t[n].cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t[n].to_numpy()) for n in names]
    return np.stack(cols, axis=1) if cols else np.zeros((t.num_rows, 0))


def _codes(b: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [np.asarray(b[n].fill_null(-1).to_numpy(zero_copy_only=False)).astype(np.int64) for n in names]


def _first_guess(z: np.ndarray, levels: Sequence[int], components: int) -> Mixture:
    p = z.shape[1]
    seen = np.isfinite(z)
    n = np.maximum(seen.sum(axis=0), 1)
    mid = np.where(seen, z, 0.0).sum(axis=0) / n
    var = np.maximum(np.where(seen, (z - mid) ** 2, 0.0).sum(axis=0) / n, 1e-6)
    var = np.where(seen.any(axis=0), var, 1.0)
    words = []
    for v in levels:
        tilt = 1 + 0.2 * np.cos(np.outer(np.arange(components) + 1, np.arange(v)))
        words.append(tilt / tilt.sum(axis=1, keepdims=True))
    lean = np.linspace(-0.3, 0.3, components)
    return Mixture(np.full(components, 1 / components), mid + lean[:, None] * np.sqrt(var), np.array([np.diag(var * s) for s in np.geomspace(0.3, 3.0, components)]).reshape(components, p, p), words)


def fit_mixture(rows: DataFrame, p: int, levels: Sequence[int], components: int = 3, rounds: int | None = None, tolerance: float = 1e-5, sample: int = 50_000) -> Mixture:
    """EM over rows (z0.., w0..): numbers as distances from their group, words as codes, NULL where missing; u, if there, is a hash of the row that chooses the sample.

    Rounds go on until the log likelihood rises by less than ``tolerance`` a row; a warning tells when ``rounds``, if given, ends them before.
    """
    names, codes = [f"z{j}" for j in range(p)], [f"w{i}" for i in range(len(levels))]
    few = rows
    if "u" in rows.columns:
        total = rows.count()
        if total > sample:
            few = rows.where(F.pmod("u", F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    start = few.select(*names, *codes).toArrow().combine_chunks()
    batch = pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in start.columns], names=start.column_names) if start.num_rows else None
    z = _matrix(batch, names) if batch is not None else np.zeros((0, p))
    model = _first_guess(z, levels, components)
    if batch is None:
        return model
    own = _codes(batch, codes)
    last = -np.inf
    for _ in itertools.count() if rounds is None else range(rounds):
        s = model.statistics(z, own)
        model = model.maximised(s)
        if not s[0] - last >= tolerance * max(s[1], 1.0):
            break
        last = s[0]
    last = -np.inf
    for _ in itertools.count() if rounds is None else range(rounds):
        here = model

        def gather(batches: Iterator[pa.RecordBatch], here: Mixture = here) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    s = here.statistics(_matrix(b, names), _codes(b, codes))
                    total = s if total is None else total + s
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "x"])

        got = rows.select(*names, *codes).mapInArrow(gather, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        s = np.zeros(len(got))
        for at, x in got:
            s[at] = x
        model = model.maximised(s)
        if not s[0] - last >= tolerance * max(s[1], 1.0):
            break
        last = s[0]
    else:
        warnings.warn(f"EM not converged to {tolerance} a row after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return model


def _sized(stats: DataFrame, what: str) -> tuple[DataFrame, bool]:
    """The statistics as a written table, and whether they are small enough to broadcast."""
    kept = written(stats, what)
    size = F.lit(8 * len(kept.columns) + 32)
    for c, t in kept.dtypes:
        if t.startswith("array"):
            size = size + F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x["say"]), F.lit(0)) + 48)
    return kept, (kept.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _hinted(stats: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(stats) if small else stats


def _modes(lists: pa.Array, wanted: np.ndarray, r: np.ndarray, model: Mixture, field: int) -> pa.Array:
    """For each wanted row the word of its list with the largest posterior, as most often spelled; NULL for the others.  r has the rows' class probabilities."""
    offsets = lists.offsets.to_numpy()
    length = np.where(wanted, np.diff(offsets), 0)
    row = np.repeat(np.arange(len(lists)), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(offsets[:-1], length)
    code, k = lists.values.field("code").to_numpy()[at], lists.values.field("k").to_numpy()[at]
    theta = model.words[field]
    prior = model.weight @ theta
    score = k * (np.einsum("rc,rc->r", r[row], theta.T[code])) / prior[code]
    order = np.lexsort((np.arange(len(row)), score, row))
    last = order[np.flatnonzero(np.r_[row[order][1:] != row[order][:-1], True])] if len(row) else order
    pick = np.full(len(lists), -1, np.int64)
    pick[row[last]] = at[last]
    return lists.values.field("say").take(pa.array(pick, mask=pick < 0))


def impute(df: DataFrame, row: str, group: str, time: str, numbers: Sequence[Number], words: Sequence[Word], components: int = 3, max_levels: int = 65536, only_filled: bool = False, helpers: Sequence[str] = ()) -> DataFrame:
    """(row, then per field: the field with its missing cells filled, and <field>_filled).

    A number can be filled if its group has usable values both on an earlier and on a later
    day; a word, if its group (or its day) has a usable one.  All else that has no usable value
    becomes NULL with <field>_filled false.  Filled words are in the spelling most frequent in
    their group or on their day; usable cells stay as they are.  Rows with a NULL group or time have no peers there and
    nothing filled from them.  Repeated rows count each.  ``helpers`` are further numeric columns that the mixture may learn from and that are not filled.
    Other columns are ignored; an empty table gives an empty result.  Words beyond the ``max_levels`` most frequent of a field share
    one class-wise frequency in the mixture; their counts in the group, which are the prior, stay their own.  With only_filled, rows
    without a filled cell are left out.
    """
    g, t = F.col(group), F.unix_date(F.col(time).cast("date"))
    modelled = [*[n.model() for n in numbers], *[finite(h) for h in helpers]]
    base = df.select(
        F.col(row).alias("row"), g.alias("g"), t.alias("t"),
        *[F.col(n.name).cast("double").alias(f"raw{j}") for j, n in enumerate(numbers)], *[m.alias(f"y{j}") for j, m in enumerate(modelled)],
        *[F.col(w.name).alias(f"say{i}") for i, w in enumerate(words)], *[w.usable().alias(f"c{i}") for i, w in enumerate(words)],
    )
    by = {"group": "g", "time": "t"}
    nums, every, fields = range(len(numbers)), range(len(modelled)), range(len(words))
    if any(len([w for w in words if w.by == b]) > 1 for b in by):
        raise ValueError("at most one word field by group and one by time")

    # one pass for the groups, one for the days: counts by spelling, from which all that follows comes
    def counted(key: str) -> DataFrame:
        mine = [i for i in fields if by[words[i].by] == key]
        y = [x for j in every for x in (F.count(f"y{j}").alias(f"n{j}"), F.sum(f"y{j}").alias(f"s{j}"))] if key == "g" else []
        y += [x for j in nums for x in (F.min(F.when(F.col(f"y{j}").isNotNull(), F.col("t"))).alias(f"lo{j}"), F.max(F.when(F.col(f"y{j}").isNotNull(), F.col("t"))).alias(f"hi{j}"))] if key == "g" else []
        return written(base.where(F.col(key).isNotNull()).groupBy(key, *[f"{x}{i}" for i in mine for x in ("c", "say")]).agg(F.count(F.lit(1)).alias("k"), *y), "impute-counts")

    parts = {key: counted(key) for key in by.values()}
    sums = parts["g"].groupBy("g").agg(*[F.sum(f"{x}{j}").alias(f"{x}{j}") for j in every for x in ("n", "s")], *[f(f"{x}{j}").alias(f"{x}{j}") for j in nums for f, x in ((F.min, "lo"), (F.max, "hi"))]) if modelled else parts["g"].select("g").distinct()
    groups, small_g = _sized(sums, "impute-groups")
    z = [F.when(F.col(f"n{j}") > 0, F.col(f"y{j}") - F.col(f"s{j}") / F.col(f"n{j}")).alias(f"z{j}") for j in every]

    # the words of the mixture, most frequent first, told by a hash: at most max_levels rows of 12 bytes
    levels, vocab, counts = [], [], []
    for i, w in enumerate(words):
        key = by[w.by]
        per = parts[key].where(f"c{i} is not null").groupBy(key, f"c{i}", f"say{i}").agg(F.sum("k").alias("k")).groupBy(key, f"c{i}").agg(F.sum("k").alias("k"), F.max_by(f"say{i}", F.struct("k", f"say{i}")).alias("say"))
        per = per.select(key, F.xxhash64(f"c{i}").alias("h"), "k", "say")
        top = per.groupBy("h").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "h").limit(max_levels).select("h").toArrow()["h"].to_pylist()
        vocab.append(df.sparkSession.createDataFrame([(h, n) for n, h in enumerate(top)], f"h long, w{i} int"))
        levels.append(len(top) + 1)
        counts.append(per)

    def coded(rows: DataFrame) -> DataFrame:
        for i in fields:
            rows = rows.withColumn("h", F.xxhash64(f"c{i}")).join(F.broadcast(vocab[i]), "h", "left").drop("h")
            rows = rows.withColumn(f"w{i}", F.when(F.col(f"c{i}").isNotNull(), F.coalesce(f"w{i}", F.lit(levels[i] - 1))))
        return rows

    # the rows with all that the later steps need, written once; the passes of EM read z and w alone
    can = [F.col(f"y{j}").isNull() & F.coalesce((F.col(f"lo{j}") < F.col("t")) & (F.col(f"hi{j}") > F.col("t")), F.lit(False)) for j in nums]
    compact = written(
        coded(base.join(_hinted(groups, small_g), "g", "left")).select(
            "row", "g", "t", *[F.when(F.col(f"y{j}").isNotNull(), F.col(f"raw{j}")).alias(f"raw{j}") for j in nums], *z, *[F.when(F.col(f"n{j}") > 0, F.col(f"s{j}") / F.col(f"n{j}")).alias(f"m{j}") for j in nums], *[c.alias(f"can{j}") for j, c in enumerate(can)],
            *[F.when(F.col(f"c{i}").isNotNull(), F.col(f"say{i}")).alias(f"say{i}") for i in fields], *[f"w{i}" for i in fields], F.xxhash64("row", "g", "t", *[f"y{j}" for j in every]).alias("u"),
        ),
        "impute-rows",
    )
    model = fit_mixture(compact, len(modelled), levels, components)

    # of each group's or day's words those that some mixture of the classes can make the mode
    def contenders(i: int) -> DataFrame:
        key, theta = by[words[i].by], model.words[i]
        ratio = theta / (model.weight @ theta)
        bounds = pa.table({"w": pa.array(np.arange(levels[i]), pa.int32()), "least": ratio.min(axis=0), "most": ratio.max(axis=0)})
        per = counts[i].join(F.broadcast(vocab[i]), "h", "left").withColumn("w", F.coalesce(f"w{i}", F.lit(levels[i] - 1))).join(F.broadcast(df.sparkSession.createDataFrame(bounds.to_pandas())), "w")
        bar = per.groupBy(key).agg(F.max(F.col("k") * F.col("least")).alias("bar"), F.max(F.when(F.col("w") == levels[i] - 1, F.col("k"))).alias("rest"))
        per = per.join(bar, key).where((F.col("k") * F.col("most") >= F.col("bar")) & ((F.col("w") < levels[i] - 1) | (F.col("k") == F.col("rest"))))
        # of the words without a class of their own only the most frequent ones are left, one by spelling
        one = per.groupBy(key, "w", F.when(F.col("w") < levels[i] - 1, F.col("h")).alias("h")).agg(F.max(F.struct("k", "say")).alias("x"))
        return one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("x.say").alias("say"), F.col("w").cast("int").alias("code"), F.col("x.k").alias("k")))).alias(f"words{i}"))

    wordless = [F.col(f"w{i}").isNull() for i in fields]
    lacks = F.lit(False)
    for c in [*[F.col(f"can{j}") for j in nums], *wordless]:
        lacks = lacks | c
    need = compact.where(lacks) if only_filled else compact
    for i, w in enumerate(words):
        need = need.join(_hinted(*_sized(contenders(i), "impute-words")), by[w.by], "left")
    can_w = [c & F.coalesce(F.size(f"words{i}") > 0, F.lit(False)) for i, c in enumerate(wordless)]
    if only_filled:
        some = F.lit(False)
        for c in [*[F.col(f"can{j}") for j in nums], *can_w]:
            some = some | c
        need = need.where(some)
    need = need.select("row", *[f"raw{j}" for j in nums], *[f"z{j}" for j in every], *[f"m{j}" for j in nums], *[f"can{j}" for j in nums], *[f"say{i}" for i in fields], *[f"w{i}" for i in fields], *[c.alias(f"canw{i}") for i, c in enumerate(can_w)], *[F.when(c, F.col(f"words{i}")).alias(f"words{i}") for i, c in enumerate(can_w)])
    kind = df.schema[row].dataType.simpleString()
    schema = f"row {kind}, " + ", ".join([f"n{j} double, fn{j} boolean" for j in nums] + [f"t{i} string, ft{i} boolean" for i in fields])
    logs = np.array([n.log for n in numbers], bool)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag = lambda b, n: np.asarray(b[n].to_numpy(zero_copy_only=False), bool)
        for b in batches:
            if not b.num_rows:
                continue
            zs, ws = _matrix(b, [f"z{j}" for j in every]), _codes(b, [f"w{i}" for i in fields])
            groups = patterns(zs)
            lj = model.log_joint(zs, ws, groups)
            r = np.exp(lj - lj.max(axis=1, keepdims=True))
            r /= r.sum(axis=1, keepdims=True)
            out = [b["row"]]
            middle = np.zeros((len(zs), len(numbers)))
            if len(logs):
                m = _matrix(b, [f"m{j}" for j in nums])
                for c in range(len(model.weight)):
                    full, rest = model.complete(zs, c, groups)
                    left = np.zeros_like(full)
                    for rows, cov in rest:
                        left[rows] = np.diag(cov)
                    full, left = full[:, : len(logs)], left[:, : len(logs)]
                    middle += r[:, [c]] * np.where(logs, np.exp(np.clip(full + m + left / 2, -700, 700)), full + m)
            for j in nums:
                can_j = flag(b, f"can{j}")
                raw = np.asarray(b[f"raw{j}"].fill_null(float("nan")).to_numpy(zero_copy_only=False))
                value = np.where(can_j, middle[:, j], raw)
                out += [pa.array(value, mask=np.isnan(value)), pa.array(can_j & np.isfinite(value))]
            for i in fields:
                can_i = flag(b, f"canw{i}")
                out += [pa.compute.coalesce(b[f"say{i}"], _modes(b[f"words{i}"], can_i, r, model, i)), pa.array(can_i)]
            yield pa.RecordBatch.from_arrays(out, names=["row", *[x for j in nums for x in (f"n{j}", f"fn{j}")], *[x for i in fields for x in (f"t{i}", f"ft{i}")]])

    done = need.mapInArrow(fill, schema)
    cols = [c for j, n in enumerate(numbers) for c in (F.col(f"n{j}").alias(n.name), F.col(f"fn{j}").alias(f"{n.name}_filled"))]
    cols += [c for i, w in enumerate(words) for c in (F.col(f"t{i}").alias(w.name), F.col(f"ft{i}").alias(f"{w.name}_filled"))]
    return done.select(F.col("row").alias(row), *cols)
