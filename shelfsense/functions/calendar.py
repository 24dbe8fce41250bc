"""Business calendar attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Payday days of the month, named holidays, seasons and promotion months.
PAYDAY_DAYS = [1, 2, 3, 15, 16, 28, 29, 30, 31]
HOLIDAYS = {
    "01-01": "New Year Day",
    "12-25": "Christmas",
    "12-26": "Boxing Day",
    "11-29": "Black Friday",
    "07-04": "Summer Sale",
}
PROMO_MONTHS = [1, 6, 7, 11, 12]


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter_reset")
        .when(month.isin(3, 4, 5), "spring_launch")
        .when(month.isin(6, 7, 8), "summer_sale")
        .otherwise("autumn_peak")
    )


def holiday_name(date: Column) -> Column:
    day_of_year = F.date_format(date, "MM-dd")
    named = None
    for key, label in HOLIDAYS.items():
        hit = day_of_year == key
        named = F.when(hit, label) if named is None else named.when(hit, label)
    return named


def calendar_columns(date: Column) -> list[Column]:
    month = F.month(date)
    return [
        date.alias("date"),
        F.date_format(date, "EEEE").alias("day_of_week"),
        F.weekofyear(date).alias("week_of_year"),
        month.alias("month"),
        F.quarter(date).alias("quarter"),
        F.year(date).alias("year"),
        (F.weekday(date) >= 5).alias("is_weekend"),
        (date == F.last_day(date)).alias("is_month_end"),
        F.dayofmonth(date).isin(PAYDAY_DAYS).alias("is_payday_period"),
        holiday_name(date).alias("holiday_name"),
        holiday_name(date).isNotNull().alias("is_public_holiday"),
        season(month).alias("retail_season"),
        month.isin(PROMO_MONTHS).alias("promo_season_flag"),
    ]


def date_dimension(facts: DataFrame, date: str) -> DataFrame:
    """Every calendar day between the first and the last date of ``facts``."""
    span = facts.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return days.select(*calendar_columns(F.col("d")))
