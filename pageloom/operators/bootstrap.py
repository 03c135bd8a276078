"""Bootstrap intervals from seeded draws that any engine can repeat."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATISTICS = {"mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max}
#: Numbers from 0 to 2^48 below which the distribution of Poisson(1) lies, for 0, 1, ... occurrences.
LIMITS = tuple(int((1 << 48) * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(13))


def weight(seed: int, resample: Column, row: Column) -> Column:
    """How often a resample holds a row: Poisson(1), from a hash of the seed, the resample and the row's name."""
    text = F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), F.coalesce(row.cast("string"), F.lit("null")))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    return functools.reduce(lambda a, b: a + b, [(u >= limit).cast("int") for limit in LIMITS])


def resamples(values: DataFrame, *keys: str, value: str = "value", order: str = "ord", times: int = 1000, seed: int = 7, statistic: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """A row per group and resample: keys, resample, stat. statistic: a name of STATISTICS, or any aggregate of a column.

    Each row stands in a resample as often as a Poisson(1) number says, which is drawing with replacement for groups of more
    than a few rows. `order` names it, by a page say, and rows of one name in different groups are drawn together. So no row is numbered, gathered or joined: it multiplies within its task, and
    sums are combined there. A resample without rows, which only a group of very few has, is left out.
    """
    at = values.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("_v"))
    drawn = at.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("_w", weight(seed, F.col("resample"), F.col(order))).where("_w > 0")
    if statistic in ("mean", "sum"):
        total = F.sum(F.col("_v") * F.col("_w"))
        return drawn.groupBy(*keys, "resample").agg((total / F.sum("_w") if statistic == "mean" else total).alias("stat"))
    rows = drawn.select(*keys, "resample", "_v", F.explode(F.sequence(F.lit(1), F.col("_w"))))
    return rows.groupBy(*keys, "resample").agg((statistic if callable(statistic) else STATISTICS[statistic])(F.col("_v")).alias("stat"))


def interval(stats: DataFrame, *keys: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of B resampled statistics: the sorted ones at floor(B a/2) and at most B - 1, floor(B (1 - a/2))."""
    alpha = 1 - level
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ranked = stats.withColumn("_r", F.row_number().over(by.orderBy("stat")) - 1).withColumn("_b", F.count("*").over(by))
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col("stat")))
    lo, hi = F.floor(F.col("_b") * (alpha / 2) + 1e-9), F.least(F.col("_b") - 1, F.floor(F.col("_b") * (1 - alpha / 2) + 1e-9))
    return ranked.groupBy(*keys).agg(at(lo).alias("lower"), at(hi).alias("upper"), F.avg("stat").alias("boot_mean"))


def confidence_interval(values: DataFrame, *keys: str, value: str = "value", order: str = "ord", times: int = 1000, level: float = 0.95, seed: int = 7, statistic: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """keys, n, mean, median, std (of the sample; 0 for one value), lower, upper."""
    base = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    ci = interval(resamples(values, *keys, value=value, order=order, times=times, seed=seed, statistic=statistic), *keys, level=level).drop("boot_mean")
    return base.join(ci, list(keys)) if keys else base.crossJoin(F.broadcast(ci))  # without keys, both have one row


def compare(values: DataFrame, group: str, a: str, b: str, value: str = "value", order: str = "ord", times: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Interval of the difference of means a - b; significant if it excludes 0. One row; none if a group is empty."""
    stats = resamples(values.where(F.col(group).isin(a, b)), group, value=value, order=order, times=times, seed=seed)
    x, y = stats.where(F.col(group) == a).select("resample", F.col("stat").alias("sa")), stats.where(F.col(group) == b).select("resample", F.col("stat").alias("sb"))
    diff = interval(x.join(y, "resample").select((F.col("sa") - F.col("sb")).alias("stat")), level=level)
    return diff.where("lower IS NOT NULL").select(F.col("boot_mean").alias("difference"), "lower", "upper", ((F.col("lower") > 0) | (F.col("upper") < 0)).alias("significant"))


def with_intervals(scores: DataFrame, values: DataFrame, *keys: str, **how) -> DataFrame:
    """scores with lower and upper bounds from their parts; null with fewer than two parts."""
    ci = confidence_interval(values, *keys, **how).where("n >= 2").select(*keys, "lower", "upper")
    return scores.join(ci, list(keys), "left")
