"""Attributes as known at event time (bitemporal as-of lookup).

Per shard of entities a persistent search tree is built by path copying: the rows enter in
the order in which they became known, each insertion copies the path from the root to its
leaf and shares all else with the version before, so every moment of known time has a
root.  An event selects the root of the last row known before it and searches that tree
for the latest valid-time key below its bound.  Where rows also end, the nodes carry the
latest end below them, which lets the search skip subtrees that hold nothing in force.

All insertions of a shard are made together, level by level, with array operations: node
``k`` of a level is the copy that insertion ``k`` makes there, its child on the path is copy
``k`` of the next level, the other child the latest earlier copy on the other side.

Events ask at the start of a day, so of the rows that share entity, valid day and day of
becoming known only the greatest can ever be an answer: they are reduced to it on the map
side.  Events are reduced to (entity, day) as well, so that neither a hot entity's rows nor
its events meet in one task unreduced; answers go back to the events by (entity, day).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOREVER = np.iinfo(np.int32).max
SHARD_ROWS = 1 << 17


class PersistentTree:
    """position[k]: the distinct rank in valid-time order of the k-th row to become known; until[k]: the first day it is no longer in force."""

    def __init__(self, position: np.ndarray, until: np.ndarray | None = None):
        n = len(position)
        self.n, self.height = n, max(1, int(n - 1).bit_length())
        h = self.height
        self.left = np.full((h, n), -1, np.int32)
        self.right = np.full((h, n), -1, np.int32)
        order = np.arange(n, dtype=np.int64)
        at = np.arange(n)
        for level in range(h):
            prefix = position[order] >> (h - level)
            starts = np.maximum.accumulate(np.where(np.r_[True, prefix[1:] != prefix[:-1]], at, 0))
            bit = (position[order] >> (h - 1 - level)) & 1
            for side, child in ((0, self.left), (1, self.right)):
                last = np.maximum.accumulate(np.where(bit == side, at, -1))
                child[level, order] = np.where(last >= starts, order[np.maximum(last, 0)], -1)
            order = order[np.argsort(prefix * 2 + bit, kind="stable")]
        self.until = None
        if until is not None:
            self.until = np.empty((h + 1, n), np.int32)
            self.until[h] = until
            for level in range(h - 1, -1, -1):
                below = self.until[level + 1]
                a, b = self.left[level], self.right[level]
                self.until[level] = np.maximum(np.where(a >= 0, below[a], -FOREVER), np.where(b >= 0, below[b], -FOREVER))

    def _open(self, level: np.ndarray | int, node: np.ndarray, day: np.ndarray) -> np.ndarray:
        return (node >= 0) & (self.until[level, np.maximum(node, 0)] > day) if self.until is not None else node >= 0

    def latest(self, root: np.ndarray, bound: np.ndarray, day: np.ndarray) -> np.ndarray:
        """Per event, in the version after insertion ``root`` (-1: none), the insertion with the greatest position < bound that is in force on ``day``; -1 if none."""
        m, h = len(root), self.height
        node = np.where((root >= 0) & (bound > 0), root, -1)
        goal = np.maximum(bound - 1, 0)
        best, best_level = np.full(m, -1, np.int64), np.full(m, h, np.int64)
        for level in range(h):  # along the path to bound - 1, keep the last subtree to its left
            safe = np.maximum(node, 0)
            right = ((goal >> (h - 1 - level)) & 1).astype(bool) & (node >= 0)
            a = np.where(node >= 0, self.left[level, safe], -1)
            take = right & self._open(level + 1, a, day)
            best, best_level = np.where(take, a, best), np.where(take, level + 1, best_level)
            node = np.where(node < 0, -1, np.where(right, self.right[level, safe], a))
        exact = self._open(h, node, day)
        best, best_level = np.where(exact, node, best), np.where(exact, h, best_level)
        for level in range(1, h):  # down to the rightmost leaf in force
            on = (best >= 0) & (best_level == level)
            safe = np.maximum(best, 0)
            r, a = self.right[level, safe], self.left[level, safe]
            best = np.where(on, np.where(self._open(level + 1, r, day), r, a), best)
            best_level = np.where(on, level + 1, best_level)
        return best


def lookup(entity: np.ndarray, valid: np.ndarray, rank: np.ndarray, known: np.ndarray, until: np.ndarray | None, ask_entity: np.ndarray, ask_day: np.ndarray, inclusive: bool) -> np.ndarray:
    """Index of the answering row per question, -1 if none.  rank orders rows of the same entity and valid day."""
    if not len(entity):
        return np.full(len(ask_entity), -1, np.int64)
    order = np.lexsort((rank, valid, entity))
    e, v = entity[order].astype(np.int64), valid[order].astype(np.int64)
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    came = np.argsort(known, kind="stable")
    tree = PersistentTree(position[came], None if until is None else until[came])
    # first position whose (entity, valid day) is beyond the question, and the entity's first position
    low, width = int(min(v.min(), ask_day.min(initial=0))), int(max(v.max(), ask_day.max(initial=0))) + 2
    codes, e_code = np.unique(e, return_inverse=True)
    a_at = np.searchsorted(codes, ask_entity)
    there = (a_at < len(codes)) & (codes[np.minimum(a_at, len(codes) - 1)] == ask_entity)
    key = e_code * (width - low + 1) + (v - low)
    ask = a_at.astype(np.int64) * (width - low + 1) + (ask_day.astype(np.int64) - low)
    bound = np.searchsorted(key, ask, side="right" if inclusive else "left")
    first = np.searchsorted(e_code, a_at, side="left")
    root = np.searchsorted(known[came], ask_day, side="left") - 1  # known on an earlier day
    found = tree.latest(np.where(there, root, -1).astype(np.int64), bound.astype(np.int64), ask_day.astype(np.int64))
    row = np.where(found >= 0, came[np.maximum(found, 0)], -1)
    return np.where((row >= 0) & (position[np.maximum(row, 0)] >= first), row, -1)


def _shards(batches: Iterator[pa.RecordBatch], inclusive: bool, ends: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by entity; whole entities are gathered up to SHARD_ROWS and answered together."""

    def answer(t: pa.Table) -> pa.RecordBatch:
        col = {c: t[c].to_numpy() for c in ("k", "d", "rank", "known", "until", "id", "ask")}
        ask = col["ask"].astype(bool)
        rows = {c: x[~ask] for c, x in col.items()}
        k, d = col["k"][ask], col["d"][ask]
        i = lookup(rows["k"], rows["d"], rows["rank"], rows["known"], rows["until"] if ends else None, k, d, inclusive)
        got = i >= 0
        return pa.RecordBatch.from_arrays([pa.array(k[got]), pa.array(d[got]), pa.array(rows["id"][i[got]])], names=["k", "d", "id"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= SHARD_ROWS:
            t = pa.Table.from_batches(held)
            k = t["k"].to_numpy()
            cut = int(np.searchsorted(k, k[-1], side="left"))
            if cut:
                yield answer(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
    if held:
        yield answer(pa.Table.from_batches(held))


def as_known(
    events: DataFrame, attributes: DataFrame, entity: str, event_day: str, valid_from: str, known_at: str, row: str, order: Sequence[str] = (), valid_until: str | None = None, inclusive: bool = True
) -> DataFrame:
    """(entity, event_day, row) for the distinct (entity, event_day) of ``events`` that have an answer.

    The answer is, among the rows of ``attributes`` for the entity that became known before the
    start of event_day, with valid_from <= event_day (< with ``inclusive`` False) and, if
    valid_until is given, event_day < valid_until, the one with the greatest
    (valid_from, order..., row).  ``row`` is a unique BIGINT id; entity is BIGINT.

    Rows with a NULL entity, valid_from, known_at or row, or with valid_until given and NULL, are
    never an answer; events with a NULL entity or day have none.  NULLs in ``order`` columns come
    first.  Other columns are ignored; empty tables give an empty result.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    rows = attributes.select(
        F.col(entity).cast("long").alias("k"),
        day(valid_from).alias("d"),
        day(known_at).alias("known"),
        (day(valid_until) if valid_until else F.lit(0)).alias("until"),
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(row).cast("long").alias("id")).alias("best"),
    ).where("k is not null and d is not null and known is not null and until is not null and best.id is not null")
    if valid_until:
        rows = rows.where("until > d")
    rows = rows.groupBy("k", "d", "known", "until").agg(F.max("best").alias("best"))
    asks = events.select(F.col(entity).cast("long").alias("k"), day(event_day).alias("d")).where("k is not null and d is not null").distinct()
    none = F.lit(0).cast("int")
    both = rows.select("k", "d", "known", "until", "best", F.lit(False).alias("ask")).unionByName(
        asks.select("k", "d", none.alias("known"), none.alias("until"), F.lit(None).cast(rows.schema["best"].dataType).alias("best"), F.lit(True).alias("ask"))
    )
    # the order among the rows of an entity and day, as a number: their place when sorted by it
    both = both.repartition("k").sortWithinPartitions("k", "ask", "d", "best")
    flat = both.select("k", "d", F.monotonically_increasing_id().alias("rank"), "known", "until", F.coalesce(F.col("best.id"), F.lit(-1)).cast("long").alias("id"), "ask")
    ends = valid_until is not None
    got = flat.mapInArrow(lambda it: _shards(it, inclusive, ends), "k long, d int, id long")
    return got.select(F.col("k").alias(entity), F.date_from_unix_date("d").alias(event_day), F.col("id").alias(row))
