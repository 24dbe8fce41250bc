"""Column expressions shared by the marts, the features and the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded_ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """``num / den`` where the denominator is positive, else ``otherwise`` (NULL or 0)."""
    ratio = F.when(den > 0, num.cast("double") / den)
    return ratio if otherwise is None else ratio.otherwise(F.lit(otherwise))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def present(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.isNotNull().cast("int")


def equals_flag(column: str, value: str) -> Column:
    return (F.coalesce(F.col(column), F.lit("")) == value).cast("int")


def banded(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound the value reaches, in the given (falling) order."""
    out = None
    for bound, label in steps:
        hit = value >= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def value_band(revenue: Column) -> Column:
    return (
        F.when(revenue >= 1500, "high_value")
        .when(revenue >= 600, "mid_value")
        .when(revenue.isNull(), "no_purchase")
        .otherwise("low_value")
    )


def discount_band(pct: Column) -> Column:
    return banded(pct, [(0.35, "deep_discount"), (0.15, "medium_discount")], "low_discount")


def demand_band(units: Column) -> Column:
    return banded(units, [(30, "high"), (10, "medium")], "low")


def performance_band(revenue: Column) -> Column:
    return banded(revenue, [(20000, "high"), (8000, "medium")], "low")


def return_risk_band(prior_rate: Column, pct: Column) -> Column:
    return (
        F.when((prior_rate >= 0.35) | (pct >= 0.35), "high")
        .when((prior_rate >= 0.15) | (pct >= 0.15), "medium")
        .otherwise("low")
    )


def response_bucket(treated: Column, control: Column, converted: Column) -> Column:
    return (
        F.when(treated & (converted == 1), "persuaded_or_sure_thing")
        .when(treated & (converted == 0), "treated_no_response")
        .when(control & (converted == 1), "organic_converter")
        .otherwise("non_converter")
    )


def location_key(channel: Column, store_id: Column) -> Column:
    """Store id for store orders; every other channel shares one online location."""
    return F.when(F.lower(channel) == "store", store_id).otherwise(F.lit("ONLINE"))


def week_start(moment: Column) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", moment).cast("date")


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed between two times (not full minutes elapsed)."""
    return F.timestamp_diff(
        "MINUTE", F.date_trunc("minute", start), F.date_trunc("minute", end)
    )


def starts_with_flag(column: str, prefix: str) -> Column:
    return F.coalesce(F.col(column).startswith(prefix), F.lit(False)).cast("int")


def joined_category(left: str, right: str) -> Column:
    return F.concat_ws(
        "_", F.coalesce(F.col(left), F.lit("unknown")), F.coalesce(F.col(right), F.lit("unknown"))
    )


def clipped(column: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        column = F.greatest(column, F.lit(low))
    if high is not None:
        column = F.least(column, F.lit(high))
    return column


def log1p_of(column: str) -> Column:
    return F.log1p(F.coalesce(F.col(column).cast("double"), F.lit(0.0)))


def week_cycle(moment: Column) -> tuple[Column, Column]:
    """Sine and cosine of the ISO week over a 52-week circle."""
    angle = F.lit(2.0) * F.pi() * F.weekofyear(moment) / F.lit(52.0)
    return F.sin(angle), F.cos(angle)


def event_weight(event_type: Column) -> Column:
    # Interaction weights per event kind.
    kind = F.lower(event_type)
    return (
        F.when(kind.isin("add_to_cart", "begin_checkout"), 2.0)
        .when(kind.isin("view_product", "product_view"), 1.0)
        .when(kind.isin("purchase"), 3.0)
        .otherwise(0.5)
    )


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that the frame has: first mention kept, order kept."""
    have = set(df.columns)
    return [c for c in dict.fromkeys(wanted) if c in have]


def refuse_columns(columns: Sequence[str], forbidden: set[str]) -> None:
    """Fail when a feature list holds a column known only after the outcome."""
    leaked = sorted(set(columns) & forbidden)
    if leaked:
        raise ValueError(f"columns that leak the outcome: {', '.join(leaked)}")
