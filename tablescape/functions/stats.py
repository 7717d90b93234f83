"""Statistics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.session import stage


def weight_statistics(df: DataFrame, weight: Column, by: list[str] = ()) -> DataFrame:
    """Count, mean, least, most, population variance and counts in five fixed bins (.2, .4, .6, .8)."""
    w = weight
    between = lambda a, b: F.count_if((w >= a) & (w < b))
    return df.groupBy(*by).agg(
        F.count(w).alias("n"), F.avg(w).alias("mean"), F.min(w).alias("least"), F.max(w).alias("most"), F.var_pop(w).alias("variance"),
        F.count_if(w < 0.2).alias("very_low"), between(0.2, 0.4).alias("low"), between(0.4, 0.6).alias("medium"), between(0.6, 0.8).alias("high"), F.count_if(w >= 0.8).alias("very_high"),
    )


#: Rows of a group that one task sorts; larger groups are narrowed by histograms of so many bins.
SORTED_ROWS, BINS = 1 << 16, 1024


def order_statistics(df: DataFrame, value: str, targets: DataFrame, by: list[str] = (), bins: int = BINS) -> DataFrame:
    """(*by, rank, value): the value at each 0-based ``rank`` of its group's sorted values, for ``targets`` (*by, rank).

    No task holds a group's values: each round counts them in bins between two
    bounds, combined before the shuffle, and the bin in which a rank falls
    gives the next bounds, by the least and the greatest value that are in it;
    it ends where both are the same. Each round reads ``df`` and narrows the
    bounds by the number of bins, so doubles take seven or so. Null values
    and groups do not count; ranks that a group does not have give no row.
    """
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ends = v.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    t = targets.select(*by, F.col("rank").cast("bigint").alias("rank")).distinct()
    t = t.join(ends, list(by)) if by else t.crossJoin(ends)  # one row
    t = stage(t.where("rank >= 0 AND rank < _n").select(*by, "rank", F.col("rank").alias("_left"), "_lo", "_hi"), "targets")
    done = [t.where("_lo = _hi")]
    open_ = t.where("_lo <> _hi")
    while not open_.isEmpty():
        rows = (v.join(open_, list(by)) if by else v.crossJoin(F.broadcast(open_))).where("_v >= _lo AND _v <= _hi")  # without groups, a row a rank
        share = (F.col("_v").cast("double") - F.col("_lo")) / (F.col("_hi").cast("double") - F.col("_lo"))
        bin_ = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(F.coalesce(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.when(~F.isnan(share), F.floor(share * bins)))), F.lit(bins // 2)))
        counts = rows.groupBy(*by, "rank", "_left", bin_.cast("int").alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        past = F.sum("_c").over(Window.partitionBy(*by, "rank").orderBy("_bin"))  # as many rows as bins
        at = counts.withColumn("_past", past).where("_left < _past AND _left >= _past - _c")
        t = stage(at.select(*by, "rank", (F.col("_left") - F.col("_past") + F.col("_c")).alias("_left"), "_lo", "_hi"), "targets")
        done.append(t.where("_lo = _hi"))
        open_ = t.where("_lo <> _hi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*by, "rank", F.col("_lo").alias("value"))


def order_statistic(df: DataFrame, value: str, rank: int):
    """The ``rank``-th smallest value, from 1 on; None where there are fewer."""
    row = order_statistics(df, value, df.sparkSession.range(rank - 1, rank).select(F.col("id").alias("rank"))).first()
    return row["value"] if row else None


def _parted(df: DataFrame, value: str, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of groups that a task may sort, those of larger ones, and the larger groups' numbers of values ``_n``."""
    sizes = df.groupBy(*by).agg(F.count(value).alias("_n")).where(F.col("_n") > SORTED_ROWS)
    if not by:
        large = not sizes.isEmpty()
        return (df.where("false"), df, sizes) if large else (df, df.where("false"), sizes)
    same = [F.col(c).eqNullSafe(F.col(f"_large_{c}")) for c in by]
    named = sizes.select(*[F.col(c).alias(f"_large_{c}") for c in by])
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi"), sizes


def percentiles_linear(df: DataFrame, value: str, points: list[float], by: list[str] = ()) -> DataFrame:
    """Linearly interpolated percentiles, one column p<n> a point.

    A group of ``SORTED_ROWS`` values at most is sorted in a task, the two
    values around a point of a larger one come from ``order_statistics``.
    Groups of a null key are groups of their own; null values do not count.
    """
    by, names = list(by), [f"p{round(p * 100)}" for p in points]
    few, many, sizes = _parted(df, value, by)
    small = few.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(n) for p, n in zip(points, names)])
    if sizes.isEmpty():
        return small
    at = lambda p: F.lit(p) * (F.col("_n") - 1)
    keyed, own = _null_safe(many.select(*by, F.col(value).cast("double").alias(value)), by)
    n, _ = _null_safe(sizes, by)
    n = stage(n, "sizes")
    ranks = n.select(*own, F.explode(F.array(*[f(at(p)).cast("bigint") for p in points for f in (F.floor, F.ceil)])).alias("rank"))
    found = order_statistics(keyed, value, ranks, own)
    pick = lambda r: F.max(F.when(F.col("rank") == r.cast("bigint"), F.col("value")))
    found = found.join(n, own) if own else found.crossJoin(n)  # one row
    lows = found.groupBy(*own, "_n").agg(*[x.alias(f"{c}{i}") for i, p in enumerate(points) for c, x in (("_f", pick(F.floor(at(p)))), ("_c", pick(F.ceil(at(p)))))])
    between = [(F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * (at(p) - F.floor(at(p)))).alias(m) for i, (p, m) in enumerate(zip(points, names))]
    large = lows.select(*[F.col(o)[0].alias(c) for o, c in zip(own, by)], *between)
    return small.unionByName(large) if by else large


def _null_safe(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with its keys in arrays, which are equal where null keys are."""
    return df.select(*[F.array(c).alias(f"_by_{c}") for c in by], *[c for c in df.columns if c not in by]), [f"_by_{c}" for c in by]


def percentiles_by_index(df: DataFrame, value: str, points: list[int], by: list[str] = ()) -> DataFrame:
    """The value at index floor(n * p / 100) of the sorted values: a value that stands in the data.

    Small groups work on the counts of distinct values, which are combined
    before the shuffle; larger ones (``SORTED_ROWS``) on ``order_statistics``.
    An index beyond the last value gives null.
    """
    by = list(by)
    few, many, sizes = _parted(df, value, by)
    counts = few.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    ran = counts.withColumn("_past", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda p: F.floor(F.col("_n") * p / 100)
    small = ran.groupBy(*by).agg(*[F.min(F.when(F.col("_past") > at(p), F.col(value))).alias(f"p{p}") for p in points])
    if sizes.isEmpty():
        return small
    keyed, own = _null_safe(many.select(*by, value), by)
    n, _ = _null_safe(sizes, by)
    n = stage(n, "sizes")
    found = order_statistics(keyed, value, n.select(*own, F.explode(F.array(*[at(p) for p in points])).alias("rank")), own)
    found = n.join(found, own, "left") if own else n.crossJoin(found)  # one row
    large = found.groupBy(*own).agg(*[F.max(F.when(F.col("rank") == at(p), F.col("value"))).alias(f"p{p}") for p in points])
    large = large.select(*[F.col(o)[0].alias(c) for o, c in zip(own, by)], *[f"p{p}" for p in points])
    return small.unionByName(large) if by else large


def positive_negative_outliers(df: DataFrame, value: str, sigmas: float = 2.0) -> DataFrame:
    """Mean, population deviation, coefficient of variation, and rows beyond ``sigmas`` deviations."""
    s = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    return df.crossJoin(F.broadcast(s)).groupBy("mean", "deviation").agg(
        F.count_if(F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("deviation")).alias("outliers"), F.count(value).alias("n")
    ).withColumn("variation", F.when(F.col("mean") != 0, F.col("deviation") / F.col("mean")))
