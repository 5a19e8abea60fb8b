"""Sequence operators that look back: sessions, capped windows, state machines, rates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltline.session import ship


def gap_sessions(df: DataFrame, group: str, order: str, start: Column, end: Column, gap: int) -> DataFrame:
    """Adds session: a new one where the distance from everything before exceeds gap."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(group).orderBy(order)
    new = F.when(start - F.max(end).over(before) <= gap, 0).otherwise(1)
    return df.withColumn("new__", new).withColumn("session", F.sum("new__").over(running)).drop("new__")


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, last: Callable, schema: str) -> DataFrame:
    """A sequential fold over the rows of each key in an order, as a stream: a task holds one state and one batch, however long a key's rows are.

    step(state, row) gives (state, rows to emit), state None at the start of a key; last(state) the rows at its end. Rows are tuples of df's columns.
    """
    names, places = [c.split()[0] for c in schema.split(", ")], [df.columns.index(k) for k in keys]

    def run(batches):
        now = state = None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = tuple(row[i] for i in places)
                if key != now:
                    out += last(state) if now is not None else []
                    now, state = key, None
                state, more = step(state, row)
                out += more
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in last(state)], kinds)

    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    ship(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def capped_windows(df: DataFrame, group: str, gap: int, cap: int, start: str = "start", end: str = "end") -> DataFrame:
    """Windows (group, start, end, n) over intervals in order of start: one closes where the next interval is further than gap, or would make it longer than cap.

    Where a window closes depends on where it began, which no window function expresses: a fold over each island of near intervals.
    Islands are cut first, so that a group is dealt out by island and not folded in one task.
    """
    islands = gap_sessions(df.select(group, start, end), group, start, F.col(start), F.col(end), gap).select(group, "session", start, end)

    def step(state, row):
        key, _, a, b = row
        if state is None:
            return [key, a, b, 1], []
        if max(state[2], b) - state[1] <= cap:
            return [key, state[1], max(state[2], b), state[3] + 1], []
        return [key, a, b, 1], [tuple(state)]

    kind = df.schema[group].dataType.simpleString()
    return folded(islands, [group, "session"], [start, end], step, lambda s: [tuple(s)], f"{group} {kind}, {start} long, {end} long, n long")


def batched(df: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Adds batch: the number of each row's batch in its key; a batch closes once the sum of its sizes reaches limit."""

    def step(state, row):
        batch, total = state or (0, 0)
        total += row[2]
        return ((batch + 1, 0) if total >= limit else (batch, total)), [(*row, batch)]

    rows = df.select(key, order, size)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return folded(rows, [key], [order], step, lambda s: [], f"{kinds}, batch long")


def closed_batches(sizes: Column, limit: int) -> Column:
    """Number of the batch of each element of an array of sizes: a batch closes once its sum reaches limit."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("batch"), F.array().cast("array<long>").alias("out"))

    def step(state: Column, size: Column) -> Column:
        total = state["sum"] + size
        full = total >= limit
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(total).alias("sum"), (state["batch"] + full.cast("long")).alias("batch"), F.concat(state["out"], F.array(state["batch"])).alias("out"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def rate(df: DataFrame, group: str, seconds: str, amount: str, span: int) -> DataFrame:
    """Adds rate: amount per second over the last `span` seconds, this row's included."""
    recent = Window.partitionBy(group).orderBy(seconds).rangeBetween(-span, 0)
    return df.withColumn("rate", F.sum(amount).over(recent) / span)
