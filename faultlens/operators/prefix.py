"""Running aggregates over ordered groups of any size.

A window partitioned by an application id would push a whole application
through one task. Here every group is cut into segments of 65,536 consecutive
order values. Each segment is handled on its own and leaves one summary row.
The summary rows of 65,536 consecutive segments are in turn a segment of the
next level, and so on for as many levels as the numbers of the order column need,
so where the order column is unique inside its group no window sees more than
65,536 rows at any level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.session import materialize, merged

SEGMENT_BITS = 16

_SEGMENT, _UPPER = "segment__", "upper_segment__"
_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def segment_of(order: Column) -> Column:
    return F.shiftright(order, SEGMENT_BITS)


def _carried(segments: DataFrame, keys: list[str], sums: list[str], maxima: list[str], levels: int) -> DataFrame:
    """Aggregates over the segments strictly before each segment of its group.

    ``segments`` has one row per segment with the segment's own aggregates.
    ``levels`` is how many times its numbers have to be cut again until one
    segment holds a whole group.
    """
    if levels <= 1:
        before = Window.partitionBy(*keys).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        return segments.select(
            *keys, _SEGMENT, *[F.sum(n).over(before).alias(n) for n in sums], *[F.max(n).over(before).alias(n) for n in maxima]
        )
    cut = segments.withColumn(_UPPER, segment_of(F.col(_SEGMENT)))
    upper = cut.groupBy(*keys, F.col(_UPPER).alias(_SEGMENT)).agg(
        *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxima]
    )
    above = _carried(upper, keys, sums, maxima, levels - 1).select(
        *keys, F.col(_SEGMENT).alias(_UPPER), *[F.col(n).alias(f"{n}__above") for n in [*sums, *maxima]]
    )
    before = Window.partitionBy(*keys, _UPPER).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select(
        *keys,
        _UPPER,
        _SEGMENT,
        *[F.sum(n).over(before).alias(n) for n in sums],
        *[F.max(n).over(before).alias(n) for n in maxima],
    )
    zero = F.lit(0)
    return inside.join(merged(above), [*keys, _UPPER]).select(
        *keys,
        _SEGMENT,
        *[(F.coalesce(n, zero) + F.coalesce(f"{n}__above", zero)).alias(n) for n in sums],
        *[F.greatest(n, f"{n}__above").alias(n) for n in maxima],
    )


def running_before(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    any_in_group: dict[str, Column] | None = None,
    summarized: DataFrame | None = None,
) -> DataFrame:
    """Add aggregates over the rows strictly before each row of its group.

    ``sums`` start at 0 and ``maxima`` at NULL. ``any_in_group`` adds flags that
    say whether the condition holds anywhere in the group. The segments are
    summarized from ``df`` unless the caller has a cheaper table with the same
    segments, such as the rows from which ``df`` was made.
    """
    sums, maxima, flags = sums or {}, maxima or {}, any_in_group or {}
    cut = df.withColumn(_SEGMENT, segment_of(F.col(order)))
    rows = cut if summarized is None else summarized.withColumn(_SEGMENT, segment_of(F.col(order)))

    names = [*sums, *maxima]
    per_segment = rows.groupBy(*keys, _SEGMENT).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()],
        *[F.max(e).alias(n) for n, e in maxima.items()],
        *[F.max(e).alias(n) for n, e in flags.items()],
    )
    levels = -(-_BITS.get(df.schema[order].dataType.typeName(), 64) // SEGMENT_BITS) - 1
    if levels > 1:
        # All levels are built from the stored segments, and there are no more than their numbers need.
        per_segment = materialize(per_segment, "segments")
        low, high = per_segment.agg(F.min(_SEGMENT), F.max(_SEGMENT)).first()
        while levels > 1 and (low or 0) >> SEGMENT_BITS * (levels - 1) == (high or 0) >> SEGMENT_BITS * (levels - 1):
            levels -= 1
    carried = _carried(per_segment, keys, list(sums), list(maxima), levels).select(
        *keys, _SEGMENT, *[F.col(n).alias(f"{n}__carried") for n in names]
    )
    if flags:
        in_group = per_segment.groupBy(*keys).agg(*[F.max(n).alias(n) for n in flags])
        carried = carried.join(merged(in_group), keys)

    inside = Window.partitionBy(*keys, _SEGMENT).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        "*",
        *[F.sum(e).over(inside).alias(f"{n}__local") for n, e in sums.items()],
        *[F.max(e).over(inside).alias(f"{n}__local") for n, e in maxima.items()],
    )
    zero = F.lit(0)
    return local.join(merged(carried), [*keys, _SEGMENT]).select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"{n}__local"), zero) + F.coalesce(F.col(f"{n}__carried"), zero)).alias(n)
            for n in sums
        ],
        *[F.greatest(f"{n}__local", f"{n}__carried").alias(n) for n in maxima],
        *flags,
    )
