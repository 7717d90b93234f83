"""Event analytics in batch: metrics, trailing windows and alerts, fixed-window limits, retention, rolling means.

A key is any column. Windows over a key are preceded by counts where they can
be, so that a key of a third of all events is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.session import stage

# The presets (requests, seconds) of the limiters.
PRESETS = {"login": (20, 900), "api": (100, 3600), "upload": (25, 3600), "read": (150, 3600), "write": (50, 3600), "project": (75, 3600), "organization": (100, 3600), "chat": (60, 60)}


def metrics(events: DataFrame, since: Column, ts: str = "ts") -> DataFrame:
    """One row: total, and events of each type since a time."""
    return events.where(F.col(ts) >= since).agg(F.count("*").alias("total"), *[F.count_if(F.col("event_type") == t).alias(t) for t in ("error", "signup", "click", "view", "purchase")])


def top_counts(events: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    return events.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def trailing_counts(events: DataFrame, key: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """(key, ts, trailing): events of the key in the last ``seconds``, open at the far end, the time itself closed.

    Equal times of a key are first counted into one row. Rows are then dealt
    by key and a stretch of ``seconds``; each also stands, as history, in the
    next stretch, which sees all that its windows reach. So a hot key is cut
    along time and no task orders all of it.
    """
    reach = seconds * 1_000_000
    times = events.where(F.col(ts).isNotNull()).groupBy(*key, ts).agg(F.count("*").alias("_n")).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    own = F.floor(F.col("_t") / reach)
    dealt = times.withColumn("_own", own).withColumn("_part", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy(*key, "_part").orderBy("_t").rangeBetween(-reach + 1, 0)
    return dealt.withColumn("trailing", F.sum("_n").over(w)).where(F.col("_part") == F.col("_own")).drop("_t", "_own", "_part", "_n")


def alerts(events: DataFrame, event_type: str, least: int, seconds: int, key: list[str] = (), ts: str = "ts") -> DataFrame:
    """(key, ts, trailing): times at which ``least`` events of a type lie in the trailing window, per key; a key of [] is all events, counted by time first."""
    some = events.where(F.col("event_type") == event_type)
    return trailing_counts(some.withColumn("_all", F.lit(0)) if not key else some, list(key) or ["_all"], seconds, ts).where(F.col("trailing") >= least).select(*key, ts, "trailing")


def fixed_windows(events: DataFrame, key: str, seconds: int, limit: int, ts: str = "ts") -> DataFrame:
    """(key, window_start, n, admitted, rejected, remaining) of epoch-aligned windows: the first ``limit`` events are admitted."""
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    start = t - t % seconds
    g = events.groupBy(key, start.alias("window_start")).agg(F.count("*").alias("n"))
    return g.withColumns({"admitted": F.least("n", F.lit(limit)), "rejected": F.greatest(F.col("n") - limit, F.lit(0)), "remaining": F.greatest(limit - F.col("n"), F.lit(0))})


def admitted(events: DataFrame, key: str, seconds: int, limit: int, order: list[str], ts: str = "ts") -> DataFrame:
    """``events`` with ``admitted`` and ``retry_after`` (whole seconds to the window's end, null if admitted); a window's events in ``order``."""
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key, "window_start").orderBy(*order)
    out = events.withColumn("window_start", t - t % seconds).withColumn("_at", F.row_number().over(w))
    out = out.withColumn("admitted", F.col("_at") <= limit)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return out.withColumn("retry_after", F.when(~F.col("admitted"), F.ceil((F.col("window_start") + seconds) - micros / 1_000_000).cast("bigint"))).drop("_at")


def retention(events: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """``events`` with ``kept``: newer than ``days`` before ``as_of``; a null time is kept."""
    return events.withColumn("kept", F.coalesce(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(True)))


def purge(events: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """What a retention job writes back: the kept rows."""
    return retention(events, as_of, days, ts).where("kept").drop("kept")


#: Rows of a key that one task orders; a larger key is cut into blocks of so many.
BLOCK = 1 << 16


def rolling_mean(events: DataFrame, key: str, value: str, order: list[str], rows: int = 100) -> DataFrame:
    """``events`` with ``rolling``: the mean of the key's last ``rows`` values, in ``order``.

    A key of more than ``BLOCK`` events is ranked over ranges of (key, order),
    which are written and may lie in one key, and cut into blocks of ranks;
    each block takes the last rows of the block before with it. Null keys are
    one key.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0)
    large = events.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    if large.isEmpty():
        return events.withColumn("rolling", F.avg(value).over(w))
    same, own, size = F.col(key).eqNullSafe(F.col("_key")), events.columns, max(BLOCK, rows)
    few = events.join(large, same, "left_anti").withColumn("rolling", F.avg(value).over(w))
    many = events.join(large, same, "left_semi")
    dealt = stage(many.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(F.col(key).alias("_key"), "_range").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    at = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range", key).orderBy(*order)) - 1)
    ranked = at.join(before.withColumnRenamed("_range", "_of"), same & (F.col("_range") == F.col("_of"))).withColumn("_at", F.col("_at") + F.col("_before")).select(*own, "_at")
    block = F.floor(F.col("_at") / size)
    late = F.col("_at") % size >= size - (rows - 1)
    copies = F.when(late, F.array(block, block + 1)).otherwise(F.array(block))
    cut = ranked.withColumn("_block", F.explode(copies))
    mean = F.avg(value).over(Window.partitionBy(key, "_block").orderBy("_at").rowsBetween(-(rows - 1), 0))
    whole = cut.withColumn("rolling", mean).where(F.floor(F.col("_at") / size) == F.col("_block")).select(*own, "rolling")
    return few.unionByName(whole)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events less than ``gap`` apart; end is the last event's time."""
    g = events.groupBy(F.session_window(F.col(ts).cast("timestamp"), gap).alias("w"), key).agg(F.count("*").alias("n"), F.max(ts).alias("end"))
    return g.select(key, F.col("w.start").alias("start"), "end", "n")


def sliding_counts(events: DataFrame, by: str, size: str, slide: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), size, slide).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")
