"""The bounded log against a plain version."""

import random
from datetime import datetime, timedelta

from tablescape.streaming import recent

SCHEMA = "event_id long, ts timestamp, user_id long"


def rows():
    rng, t, out = random.Random(8), datetime(2024, 1, 1), []
    for i in range(240):
        t += timedelta(minutes=rng.choice([1, 5, 60]))
        out.append((i, t + timedelta(minutes=rng.choice([0, -40])), None if i % 29 == 0 else rng.randrange(4)))
    return out + [(900, None, 1), (None, t, 1)]


def plain(events, most, hours):
    out = {}
    for i, t, k in events:
        if t is not None and i is not None:
            out.setdefault(k, []).append((t, i))
    done = {}
    for k, e in out.items():
        e = sorted(e)
        new = e[-1][0]
        done[k] = (len(e), [i for t, i in e if t >= new - timedelta(hours=hours)][-most:])
    return done


def test_batch(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    for most, hours in ((7, 24.0), (1000, 6.0), (1, 1.0)):
        got = {r["key"]: (r["seen"], r["event_ids"]) for r in recent.recent_log(df, "user_id", most, hours).collect()}
        assert got == plain(rows(), most, hours)
    assert recent.recent_log(df.where("false"), "user_id").count() == 0
