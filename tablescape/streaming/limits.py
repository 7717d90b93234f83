"""Stateful event processing: progressive rate limits, token buckets, circuit breakers, alerts, as streams and as batch.

The per-key transitions are small functions shared by both. A stream keeps the
state between batches; in batch the events of a key are cut into runs that a
task folds in order (state passes from run to run), so a hot key is one
ordered pass in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Penalty:
    """Progressive rate limit: ``limit`` events a window, less with each violation; violations decay after ``decay`` seconds."""

    limit: int = 100
    window: float = 900.0
    decay: float = 3600.0
    most: float = 3.0

    schema = "start double, count bigint, violations bigint, last double, factor double"
    start = (-1.0, 0, 0, 0.0, 1.0)
    output = "admitted boolean, effective bigint, violations bigint"

    def step(self, state: tuple, t: float, _: float) -> tuple[tuple, tuple]:
        start, count, violations, last, factor = state
        window = t // self.window * self.window
        if window != start:
            start, count = window, 0
        effective = max(1, int(self.limit / factor))
        if count < effective:
            return (start, count + 1, violations, last, factor), (True, effective, violations)
        if last and t - last > self.decay:
            violations = max(0, violations - 1)
        violations += 1
        return (start, count, violations, t, min(self.most, 1 + violations * 0.5)), (False, effective, violations)


@dataclass(frozen=True)
class Bucket:
    """Token bucket: ``capacity`` tokens, ``rate`` a second; the wait in seconds where a token is short."""

    capacity: float = 50.0
    rate: float = 1.0

    schema = "tokens double, last double"
    start = (-1.0, 0.0)
    output = "admitted boolean, tokens double, wait double"

    def step(self, state: tuple, t: float, _: float) -> tuple[tuple, tuple]:
        tokens, last = state
        tokens = self.capacity if tokens < 0 else min(self.capacity, tokens + max(0.0, t - last) * self.rate)
        if tokens >= 1:
            return (tokens - 1, t), (True, tokens - 1, 0.0)
        return (tokens, t), (False, tokens, (1 - tokens) / self.rate)


@dataclass(frozen=True)
class Breaker:
    """Circuit breaker over calls that succeed (value >= 0) or fail: opens at ``failures`` in a row, tries again after ``rest`` seconds."""

    failures: int = 5
    rest: float = 60.0

    schema = "state string, run bigint, opened double"
    start = ("CLOSED", 0, 0.0)
    output = "state string, admitted boolean"

    def step(self, state: tuple, t: float, value: float) -> tuple[tuple, tuple]:
        name, run, opened = state
        if name == "OPEN":
            if t - opened < self.rest:
                return state, ("OPEN", False)
            name = "HALF_OPEN"
        if value >= 0:
            return ("CLOSED", 0, 0.0), ("CLOSED", True)
        run += 1
        if name == "HALF_OPEN" or run >= self.failures:
            return ("OPEN", run, t), ("OPEN", True)
        return ("CLOSED", run, 0.0), ("CLOSED", True)


def _rows(machine, state: tuple, key, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    out = []
    for i, t, v in zip(pdf["event_id"], pdf["t"], pdf["value"]):
        state, said = machine.step(state, float(t), float(v))
        out.append((key, i, t, *said))
    return state, pd.DataFrame(out, columns=["key", "event_id", "t", *[c.split()[0] for c in machine.output.split(", ")]])


def prepared(events: DataFrame, key: str, value=None, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(key, event_id, t, value): seconds since the epoch, and what the machine judges."""
    return events.select(F.col(key).alias("key"), F.col(event_id).alias("event_id"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).alias("t"), (value if value is not None else F.lit(0.0)).cast("double").alias("value"))


def fold(events: DataFrame, machine, key: str, value=None, **names: str) -> DataFrame:
    """(key, event_id, t, *outputs) of every event, each key's in the order of time and id.

    Events are dealt by key and sorted; a task folds them as they come,
    batch by batch, and holds one key's state only.
    """
    rows = prepared(events, key, value, **names)
    k = rows.schema["key"].dataType.simpleString()
    i = rows.schema["event_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), machine.start
        for pdf in batches:
            for name, part in pdf.groupby("key", sort=False, dropna=False):
                if name != at and not (pd.isna(name) and pd.isna(at)):
                    at, state = name, machine.start
                state, out = _rows(machine, state, name, part)
                yield out

    return rows.repartition("key").sortWithinPartitions("key", "t", "event_id").mapInPandas(run, f"key {k}, event_id {i}, t double, {machine.output}")


def stream(events: DataFrame, machine, key: str, value=None, idle: str | None = None, **names: str) -> DataFrame:
    """As ``fold``, over a stream: state a key between batches; a batch's events in the order of time and id. ``idle``: state goes after so long."""
    rows = prepared(events, key, value, **names)
    k = rows.schema["key"].dataType.simpleString()
    i = rows.schema["event_id"].dataType.simpleString()

    def update(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else machine.start
        now, out = _rows(machine, tuple(now), name[0], pd.concat(list(parts)).sort_values(["t", "event_id"]))
        state.update(now)
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield out

    return rows.groupBy("key").applyInPandasWithState(update, f"key {k}, event_id {i}, t double, {machine.output}", machine.schema, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def windowed_alerts(events: DataFrame, event_type: str, key: str, least: int, size: str, slide: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(key, start, n): sliding windows in which a key has ``least`` events of a type; with a watermark, for streams and batch."""
    some = events.where(F.col("event_type") == event_type).withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return some.groupBy(F.window("_t", size, slide).alias("w"), F.col(key)).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key, F.col("w.start").alias("start"), "n")


def counted(events: DataFrame, size: str, by: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(by, start, n) of tumbling windows with a watermark."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(F.window("_t", size).alias("w"), F.col(by)).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def in_batches(df: DataFrame, call: Callable[[list], list], column: str, output: str, size: int = 10, tries: int = 5) -> DataFrame:
    """``df`` with ``result`` from an external ``call`` on lists of ``size`` values, tried up to ``tries`` times with waits that double; ``output`` is its type."""
    import random
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list = []
            for at in range(0, len(pdf), size):
                for left in range(tries, 0, -1):
                    try:
                        got += call(pdf[column].iloc[at : at + size].tolist())
                        break
                    except ConnectionError:
                        if left == 1:
                            raise
                        time.sleep(0.05 * 2 ** (tries - left) * random.uniform(0.75, 1.25))
            yield pdf.assign(result=got)

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", result {output}")
