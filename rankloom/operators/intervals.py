"""Overlapping and gapped time intervals.

A mergeable aggregate: the state of a key is its sorted list of disjoint intervals, and
two states combine by a merge of the two lists.  It is evaluated as a reduction tree -

* leaves: every input partition reduces its own rows to lists per key, a buffer at a time (no shuffle),
* inner level: the lists of a key meet in groups of at most ``1/fan`` of the leaves, so a
  key that holds a third of all rows is still spread over ``fan`` tasks,
* root: the at most ``fan`` lists of a key meet, and lists and complements are emitted.

A list has at most half as many intervals as there are days.  A leaf holds one buffer of fixed size, an inner node, whose lists come sorted,
a buffer or the lists of one key, so no node grows with the number of rows or keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUFFER_ROWS = 1 << 16


def merge_sorted(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals per integer key; touching intervals are continuous."""
    if not len(keys):
        return keys, start, end
    order = np.lexsort((start, keys))
    k, s, e = keys[order], start[order], end[order]
    # a running maximum of the ends within each key: lift every key above the range of the former
    low, span = int(min(s.min(), e.min())), int(max(s.max(), e.max()))
    rank = np.cumsum(np.r_[0, k[1:] != k[:-1]])
    width = span - low + 1
    if (int(rank[-1]) + 1) * width < 1 << 62:
        reach = np.maximum.accumulate((e - low) + rank * width) - rank * width + low
    else:  # too wide to lift: one accumulate per key
        cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(e, cuts[1:])])
    opens = np.r_[True, (k[1:] != k[:-1]) | (s[1:] > reach[:-1])]
    first = np.flatnonzero(opens)
    last = np.r_[first[1:] - 1, len(k) - 1]
    return k[first], s[first], reach[last]


def _reduced(parts: list[pa.RecordBatch]) -> pa.Table:
    """Disjoint lists per (key, slot), keys in the order in which they come."""
    t = pa.Table.from_batches(parts).combine_chunks()
    code = t["k"].combine_chunks().dictionary_encode()
    if isinstance(code, pa.ChunkedArray):
        code = code.combine_chunks()
    width = int(t["slot"].to_numpy().max()) + 1
    k, s, e = merge_sorted(code.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + t["slot"].to_numpy(), t["s"].to_numpy(), t["e"].to_numpy())
    return pa.table({"k": code.dictionary.take(pa.array(k // width)), "slot": pa.array((k % width).astype(np.int32)), "s": pa.array(s), "e": pa.array(e)})


def _leaf(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Reduces the rows of a partition buffer by buffer; what several buffers have of a key meets in the next level."""
    mine = TaskContext.get().partitionId() % slots if TaskContext.get() else 0
    waiting: list[pa.RecordBatch] = []
    rows = 0

    def give() -> Iterator[pa.RecordBatch]:
        t = _reduced(waiting)
        yield from t.set_column(1, "slot", pa.array(np.full(t.num_rows, mine, np.int32))).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        waiting.append(b)
        rows += b.num_rows
        if rows >= BUFFER_ROWS:
            yield from give()
            waiting, rows = [], 0
    if waiting:
        yield from give()


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduces lists that come sorted by (key, slot): a buffer, and never less than one key's lists, is held at a time."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        waiting.append(b)
        rows += b.num_rows
        if rows >= BUFFER_ROWS:
            t = pa.Table.from_batches(waiting).combine_chunks()
            last = np.asarray(pa.compute.equal(t["k"], t["k"][-1]).to_numpy(), bool) & (t["slot"].to_numpy() == t["slot"][-1].as_py())
            cut = int(np.argmax(last))
            if cut:
                yield from _reduced(t.slice(0, cut).to_batches()).to_batches()
                waiting, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if waiting:
        yield from _reduced(waiting).to_batches()


def merge_intervals(df: DataFrame, key: str, start: str, end: str, fan: int = 32) -> DataFrame:
    """(key, from_day, to_day): the longest continuous periods that the [start, end) intervals of a key cover.

    start and end are DATE columns.  Rows whose key, start or end is NULL and empty or
    reversed intervals cover nothing.  Repeated rows change nothing.  Other columns, of
    whatever name, are ignored; an empty table gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, slot int, s bigint, e bigint"
    rows = df.select(
        F.col(key).alias("k"), F.lit(0).alias("slot"), F.unix_date(F.col(start).cast("date")).cast("long").alias("s"), F.unix_date(F.col(end).cast("date")).cast("long").alias("e")
    ).where(F.col("k").isNotNull() & (F.col("s") < F.col("e")))
    leaves = rows.mapInArrow(lambda it: _leaf(it, fan), schema)
    inner = leaves.repartition("k", "slot").sortWithinPartitions("k", "slot").mapInArrow(_inner, schema)
    top = inner.withColumn("slot", F.lit(0)).repartition("k").sortWithinPartitions("k").mapInArrow(_inner, schema)
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return top.select(F.col("k").alias(key), day("s").alias("from_day"), day("e").alias("to_day"))


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, fan: int = 32) -> DataFrame:
    """(key, kind, from_day, to_day): the periods of merge_intervals and, as kind 'gap', their complement between the first and the last.

    The list of a key is already disjoint and in one task, so the gaps need no further shuffle.
    """
    merged = merge_intervals(df, key, start, end, fan)
    kind = merged.schema[key].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # the last period of the key that is open: the lists arrive sorted by (key, start)
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held:
                t = pa.concat_tables([held["row"], t])
            ks = t[0].combine_chunks()
            ks = ks.combine_chunks() if isinstance(ks, pa.ChunkedArray) else ks
            same = np.asarray(pa.compute.equal(ks.slice(0, len(ks) - 1), ks.slice(1)).to_numpy(zero_copy_only=False), dtype=bool)
            i = np.flatnonzero(same)
            skip = 1 if held else 0
            f, u = t["from_day"].combine_chunks(), t["to_day"].combine_chunks()
            n = t.num_rows - skip
            out = pa.table(
                {
                    key: pa.concat_arrays([ks.slice(skip), ks.take(pa.array(i))]),
                    "kind": pa.array(["period"] * n + ["gap"] * len(i)),
                    "from_day": pa.concat_arrays([f.slice(skip), u.take(pa.array(i))]),
                    "to_day": pa.concat_arrays([u.slice(skip), f.take(pa.array(i + 1))]),
                }
            )
            held = {"row": t.slice(t.num_rows - 1)}
            yield from out.to_batches()

    return merged.mapInArrow(emit, f"`{key}` {kind}, kind string, from_day date, to_day date")
