"""Sums, means and spreads whose bits do not depend on the order of the rows.

Adding doubles rounds after every step, so partitions and merges show in the
last bits, and a value near a tie then rounds either way. Here a double is cut
into whole numbers of fixed weight, which decimals add without rounding; only
the finished sum is rounded. Deviations are taken from the finished mean, in a
second pass, so nothing cancels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the whole numbers that a double is cut into, as powers of two.
#: What is below the last one, 1e-21, is left out.
WEIGHTS = (60, 0, -35, -70)
#: Doubles from here on, and those that are not finite, are summed as they are.
LARGEST = 2.0**120


def _total(whole: Column) -> Column:
    return F.sum(whole.cast("decimal(20,0)"))


def _whole(value: Column) -> Column:
    """The whole part of a double, as a double of any size."""
    return value - value % F.lit(1.0)


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of doubles; NULL without any."""
    value = value.cast("double")
    inside = F.when(F.abs(value) < LARGEST, value).otherwise(F.when(value.isNotNull(), F.lit(0.0)))
    parts, above = [], None
    for weight in WEIGHTS:
        # Powers of two only move the point, so every step here is exact.
        number = _whole(inside * F.lit(2.0**-weight))
        if above is not None:
            number = number - _whole(inside * F.lit(2.0**-above)) * F.lit(2.0 ** (above - weight))
        parts.append(_total(number).cast("double") * F.lit(2.0**weight))
        above = weight
    found = reduce(lambda low, high: high + low, reversed(parts))
    return F.when(F.max(F.abs(value)) < LARGEST, found).otherwise(F.sum(value))


def exact_mean(value: Column) -> Column:
    """Aggregate: the mean of doubles; NULL without any."""
    return F.try_divide(exact_sum(value), F.count(value))


def whole_mean(value: Column) -> Column:
    """Aggregate: the mean of whole numbers."""
    return F.try_divide(_total(value).cast("double"), F.count(value))


def whole_variance(value: Column) -> Column:
    """Aggregate: the sample variance of whole numbers, in one pass; NULL for fewer than two.

    With n, sum S = m n + r and sum of squares Q, the squares of the distances
    from m add up to Q - m (S + r), a whole number. Where squares do not fit
    38 digits it is that of ``var_samp``.
    """
    n, one = F.count(value), value.cast("decimal(20,0)")
    total, squares = F.sum(one).cast("decimal(38,0)"), F.try_sum(F.when(F.abs(one) < F.lit(10**17), one.cast("decimal(18,0)") * one.cast("decimal(18,0)")).cast("decimal(38,0)"))
    middle = F.floor(F.try_divide(total, n)).cast("decimal(19,0)")
    rest = total - middle * n.cast("decimal(19,0)")
    apart = (squares - middle * (total + rest)).cast("double")
    rest = rest.cast("double")
    exact = F.greatest(apart - rest * F.try_divide(rest, n), F.lit(0.0))
    inside = F.max(F.abs(one)) < F.lit(10**17)
    return F.when(n > 1, F.coalesce(F.when(inside, F.try_divide(exact, n - 1)), F.var_samp(value)))


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of their group's row; null keys meet each other."""
    there = groups.withColumnsRenamed({k: f"{k}__there" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__there")) for k in keys], F.lit(True))
    return rows.join(there, same, how).drop(*[f"{k}__there" for k in keys])


def spread(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, n, mean, std, min, max of the doubles ``value`` in every group; std is NULL for fewer than two.

    Two passes over ``rows``, best a stored table; between them is a row for each group.
    """
    one = rows.groupBy(*keys).agg(F.count(value).alias("n"), exact_mean(F.col(value)).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    apart = _beside(rows, one.select(*keys, "mean"), keys).select(*keys, (F.col(value).cast("double") - F.col("mean")).alias("apart"))
    squares = apart.groupBy(*keys).agg(exact_sum(F.col("apart") * F.col("apart")).alias("squares"))
    std = F.when(F.col("n") > 1, F.when(F.col("min") == F.col("max"), F.lit(0.0)).otherwise(F.sqrt(F.try_divide("squares", F.col("n") - 1))))
    return _beside(one, squares, keys).select(*keys, "n", "mean", std.alias("std"), "min", "max")


def correlation(rows: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys and the Pearson correlation over the rows that have both values; NULL where one side never varies."""
    both = rows.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y"))
    held = both.filter("x IS NOT NULL AND y IS NOT NULL")
    varies = F.least(F.max("x") - F.min("x"), F.max("y") - F.min("y")) > 0
    means = held.groupBy(*keys).agg(exact_mean(F.col("x")).alias("mx"), exact_mean(F.col("y")).alias("my"), varies.alias("varies"))
    apart = _beside(held, means, keys).select(*keys, "varies", (F.col("x") - F.col("mx")).alias("dx"), (F.col("y") - F.col("my")).alias("dy"))
    dx, dy = F.col("dx"), F.col("dy")
    alike = F.try_divide(exact_sum(dx * dy), F.sqrt(exact_sum(dx * dx)) * F.sqrt(exact_sum(dy * dy)))
    found = apart.groupBy(*keys).agg(F.when(F.max("varies"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), alike))).alias("pearson"))
    return _beside(rows.select(*keys).distinct(), found, keys, "left").select(*keys, "pearson") if keys else found
