"""A bounded log of each key's newest events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.streaming.limits import prepared

#: Events that a log keeps, and hours after which one is gone.
MOST, HOURS = 1000, 24.0


def recent_log(events: DataFrame, key: str, most: int = MOST, hours: float = HOURS, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(key, seen, event_ids, oldest, newest): of each key the number of its events and its newest ``most`` of the ``hours`` up to its newest one, ordered by time and id.

    The newest rows are cut before the shuffle, so a task holds ``most`` rows a
    key; null times and ids go, a null key is a key.
    """
    rows = prepared(events, key, ts=ts, event_id=event_id).where("t IS NOT NULL AND event_id IS NOT NULL").withColumn("event_id", F.col("event_id").cast("bigint"))
    last = rows.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("t"), F.desc("event_id")))).where(F.col("at") <= most)
    new = F.max("t").over(Window.partitionBy("key"))
    kept = last.withColumn("newest", new).where(F.col("t") >= F.col("newest") - hours * 3600)
    logs = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("log"), F.min("t").alias("oldest"), F.max("newest").alias("newest"))  # ``most`` a key
    seen = rows.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("seen"))
    return logs.join(seen, F.col("key").eqNullSafe(F.col("_key"))).select("key", "seen", F.col("log.event_id").alias("event_ids"), "oldest", "newest")
