"""Small column builders; all of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.functions.constants import LABEL_NAMES, UNKNOWN


def money(name: str) -> Column:
    """A price as an exact decimal, so sums do not depend on row order."""
    return F.col(name).cast("decimal(12,2)")


def exact(name: str, digits: int = 9) -> Column:
    """A measure as a decimal with ``digits`` decimals, so sums do not depend on row order.

    A double below 10^6 has no more digits than that; larger values keep all
    they have up to 10^15. Prices take ``money``.
    """
    return F.col(name).cast(f"decimal({15 + digits},{digits})")


def rate(name: str) -> Column:
    return F.col(name).cast("decimal(4,2)")


def net_price() -> Column:
    """Extended price after discount; decimal(18,4), still a machine long."""
    return money("l_extendedprice") * (F.lit(1) - rate("l_discount"))


def total(expr: Column | str) -> Column:
    """Exact decimal sum, shown as a double."""
    return F.sum(expr).cast("double")


def label_name(label: Column, names: dict[int, str] = LABEL_NAMES) -> Column:
    pairs = [F.lit(part) for item in names.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label.cast("int")), F.lit(UNKNOWN))


def parent_id_array(text: Column) -> Column:
    """Distinct integer ids of a comma-separated list; bad tokens are ignored."""
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t).try_cast("int"))
    return F.array_distinct(F.filter(tokens, lambda v: v.isNotNull()))


def is_failed() -> Column:
    return F.col("status") == "FAILED"


def is_logical_abort() -> Column:
    """A stage that was skipped, or whose reason says it was cancelled or aborted."""
    reason = F.lower(F.coalesce(F.col("failure_reason"), F.lit("")))
    return (F.col("status") == "SKIPPED") | reason.contains("cancelled") | reason.contains("aborted")


def ratio(numerator: Column, denominator: Column, otherwise: float) -> Column:
    """numerator / denominator where the denominator is positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(otherwise))


def format_bytes(size: Column) -> Column:
    """Byte counts as text: whole bytes, then KB, MB and GB with two decimals."""
    kib = 1024
    return (
        F.when(size < kib, F.format_string("%d B", size))
        .when(size < kib**2, F.format_string("%.2f KB", size / F.lit(float(kib))))
        .when(size < kib**3, F.format_string("%.2f MB", size / F.lit(float(kib**2))))
        .when(size >= kib**3, F.format_string("%.2f GB", size / F.lit(float(kib**3))))
    )
