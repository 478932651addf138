"""Column functions for dates at daily, weekly (Saturday) and annual frequency."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_end(year: Column | str) -> Column:
    return F.make_date(_col(year), F.lit(12), F.lit(31))


def week_end(date: Column | str) -> Column:
    """The Saturday that closes the week of the date."""
    date = _col(date)
    return F.date_add(date, F.pmod(F.lit(5) - F.weekday(date), F.lit(7)))


def period_end(date: Column | str, frequency: Column | str) -> Column:
    date, frequency = _col(date), _col(frequency)
    return (
        F.when(frequency == "weekly", week_end(date))
        .when(frequency == "annual", year_end(F.year(date)))
        .otherwise(date)
    )


def target_date(date: Column | str, frequency: Column | str, steps: Column | str | int) -> Column:
    """Date the forecast is for: steps days, weeks or calendar years ahead (at least one step)."""
    date, frequency = _col(date), _col(frequency)
    steps = F.lit(steps) if isinstance(steps, int) else _col(steps)
    steps = F.greatest(F.coalesce(steps.cast("int"), F.lit(1)), F.lit(1))
    return (
        F.when(frequency == "annual", F.add_months(date, steps * 12))
        .when(frequency == "weekly", F.date_add(date, steps * 7))
        .otherwise(F.date_add(date, steps))
    )


def day_of_week(date: Column | str) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(_col(date)) + 1


def calendar_features(date: Column | str) -> dict[str, Column]:
    date = _col(date)
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day_of_week": day_of_week(date),
        "is_weekend": (day_of_week(date) >= 6).cast("int"),
    }
