"""Column expressions shared by every operator (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rebuy.config import CART_WEIGHT, INVALID_ITEM_IDS, PURCHASE_WEIGHT, VIEW_WEIGHT

# Decayed signals are doubles of any size: a customer's or an item's newest signal may be years old,
# and only sizes relative to each other count. Totals are ranked by their logarithm to DIGITS
# digits, so that the order in which tasks finish cannot change a rank.
DIGITS = 10
# Quantities, prices and list scores have a natural size. They are summed as whole billionths (over
# WIDE, which cannot overflow), shares of at most 1 as whole units of SHARE over bigint.
SCALE = 1e9
SHARE = 1e11
WIDE = "decimal(18,0)"
RATE = "decimal(18,12)"


def instant(df: DataFrame, column: str, value: str) -> Column:
    """A literal of the column's own type, so the comparison reaches the scan."""
    return F.lit(value).cast(df.schema[column].dataType)


def before(df: DataFrame, column: str, end: str) -> Column:
    return F.col(column) < instant(df, column, end)


def within(df: DataFrame, column: str, start: str | None, end: str) -> Column:
    bounds = [before(df, column, end)]
    if start is not None:
        bounds.append(F.col(column) >= instant(df, column, start))
    return every(bounds)


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def valid_item(column: str = "item_id") -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*INVALID_ITEM_IDS)


def age_days(column: str, anchor: str) -> Column:
    """Whole 24-hour periods up to the anchor, never negative.

    Not ``datediff``, which counts midnights.
    """
    gap = F.lit(anchor).cast("timestamp_ntz") - F.col(column).cast("timestamp_ntz")
    return F.greatest(F.extract(F.lit("DAY"), gap), F.lit(0))


def recency(column: str, anchor: str, half_life_days: float) -> Column:
    return F.exp(-age_days(column, anchor).cast("double") / F.lit(float(half_life_days)))


def quantity_boost(column: str = "quantity") -> Column:
    """``1 + ln(max(quantity, 1))``; a null quantity stays null."""
    quantity = F.col(column).cast("double")
    return F.when(quantity.isNotNull(), 1.0 + F.ln(F.greatest(quantity, F.lit(1.0))))


def purchase_points(anchor: str, half_life_days: float) -> Column:
    return F.lit(PURCHASE_WEIGHT) * quantity_boost() * recency("updated_date", anchor, half_life_days)


def event_points(anchor: str, half_life_days: float) -> Column:
    weight = F.when(F.col("event_type") == "add_to_cart", F.lit(CART_WEIGHT)).otherwise(F.lit(VIEW_WEIGHT))
    return weight * quantity_boost() * recency("event_date", anchor, half_life_days)


def billionths(score: Column) -> Column:
    """Nearest whole number of billionths (bigint)."""
    return F.floor(score * F.lit(SCALE) + F.lit(0.5))


def shares(score: Column) -> Column:
    """Nearest whole number of SHARE units (bigint), for scores relative to a best one."""
    return F.floor(score * F.lit(SHARE) + F.lit(0.5))


def total_points(column: str = "points") -> Column:
    """Sum of points; 0 where every value is null."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def strength(column: str = "points") -> Column:
    """Points to rank by: their logarithm to DIGITS digits, null for 0 (which sorts last when descending)."""
    return F.round(F.ln(column), DIGITS)


def zero(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 for an empty or zero denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))
