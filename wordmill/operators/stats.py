"""Statistics over groups: durations, moments, agreement, robust scales, audits and resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duration_stats(rows: DataFrame, keys: Sequence[str], value: str, percents: Mapping[str, float], exact: bool = True) -> DataFrame:
    """Count, mean, population deviation, percentiles (linear between ranks), least and greatest of each group.

    exact keeps a group's distinct values with their counts; otherwise sketches of bounded size serve.
    """
    points = list(percents.values())
    q = F.percentile(value, F.array(*(F.lit(p) for p in points))) if exact else F.percentile_approx(value, points)
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), q.alias("q"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return found.select(*keys, "n", "mean", "std", *(F.get("q", F.lit(i)).alias(name) for i, name in enumerate(percents)), "low", "high")


def micro_rate(rate: str, weight: str) -> Column:
    """Rates averaged by weight; null without weight."""
    return F.try_divide(F.sum(F.col(rate) * F.col(weight)), F.sum(weight))


def array_moments(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Elements, mean and population deviation over all elements of a group's arrays, without exploding them."""
    def fold(power: int) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, x: a + (x.cast("double") if power == 1 else x.cast("double") * x.cast("double")))

    sums = rows.groupBy(*keys).agg(F.sum(F.size(column)).alias("n"), F.sum(fold(1)).alias("s"), F.sum(fold(2)).alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select(*keys, "n", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("std"))


def pair_agreement(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation, ratios of deviations and means, and mean absolute difference; null where undefined."""
    return rows.groupBy(*keys).agg(
        F.round(F.corr(a, b), 6).alias("pearson"),
        F.round(F.try_divide(F.stddev_pop(a), F.stddev_pop(b)), 6).alias("std_ratio"),
        F.round(F.try_divide(F.avg(a), F.avg(b)), 6).alias("mean_ratio"),
        F.round(F.avg(F.abs(F.col(a) - F.col(b))), 4).alias("mae"),
    )


def robust_scale(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """centre (median) and scale of each group: 1.4826 times the median deviation, else the deviation, else 1."""
    centre = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("centre"), F.stddev_pop(value).alias("spread"))
    away = rows.join(centre, list(keys)).groupBy(*keys).agg(
        F.first("centre").alias("centre"), F.first("spread").alias("spread"), (F.percentile(F.abs(F.col(value) - F.col("centre")), F.lit(0.5)) * 1.4826).alias("mad")
    )
    scale = F.when(F.col("mad") >= 1e-8, F.col("mad")).when(F.col("spread") >= 1e-8, F.col("spread")).otherwise(1.0)
    return away.select(*keys, "centre", scale.alias("scale"))


def with_reference(rows: DataFrame, levels: Sequence[Sequence[str]], value: str, least: int) -> DataFrame:
    """rows with reference: the mean of the first level's group that has enough rows; the last level always serves.

    Every level is one small aggregate that is joined back: linear in the rows.
    """
    out = rows
    parts = []
    for number, keys in enumerate(levels):
        group = rows.groupBy(*keys).agg(F.avg(value).alias(f"m{number}"), F.count("*").alias(f"n{number}"))
        out = out.join(group, list(keys)) if keys else out.join(F.broadcast(group))  # one row
        last = number == len(levels) - 1
        parts.append(F.col(f"m{number}") if last else F.when(F.col(f"n{number}") >= least, F.col(f"m{number}")))
    return out.withColumn("reference", F.coalesce(*parts))


def distribution_audit(rows: DataFrame, group: str, dimensions: Sequence[str], state: str) -> DataFrame:
    """Counts by state for every bucket of every dimension, acceptance rate and change of share in points."""
    long = rows.unpivot([group, state], list(dimensions), "dimension", "bucket")
    s = F.col(state)
    counts = long.groupBy(group, "dimension", "bucket").agg(F.count("*").alias("n"), *(F.count_if(s == x).alias(x) for x in ("accepted", "rejected", "pending")))
    by = Window.partitionBy(group, "dimension")
    rate = F.try_divide(F.col("accepted"), F.col("accepted") + F.col("rejected"))
    change = F.try_divide(F.col("accepted"), F.sum("accepted").over(by)) - F.col("n") / F.sum("n").over(by)
    return counts.select("*", F.round(rate, 6).alias("rate"), F.round(100 * change, 6).alias("change"))


def bootstrap_interval(rows: DataFrame, key: str, value: Column, repeats: int, seed: str = "boot") -> DataFrame:
    """(mean, low, high): a 95 % interval of the mean of value, resampled with Poisson(1) weights.

    A weight is read off a hash of seed, repeat and key, so it doesn't depend on the partitioning.
    Sums of all repeats are taken in one pass; only `repeats` rows are left for the percentiles.
    """
    steps = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)  # chances of at most 0, 1, ... in Poisson(1)
    spread = rows.select(F.col(key).alias("k"), value.alias("v")).where("v is not null").select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    u = F.pmod(F.xxhash64(F.lit(seed), "rep", "k"), F.lit(1 << 30)) / float(1 << 30)
    weight = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    means = spread.groupBy("rep").agg(F.try_divide(F.sum(F.col("v") * weight), F.sum(weight)).alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rows.agg(F.avg(value).alias("mean")).join(F.broadcast(bounds))
