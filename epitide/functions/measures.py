"""Column functions for measures: revisions, rates, growth, errors, risk buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from epitide import schema


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_zero(c: Column | str) -> Column:
    """Negative values to zero; a missing value stays missing."""
    c = _col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def clip_negative(df: DataFrame, raw: str, clean: str, flag: str) -> DataFrame:
    """Keep the raw revision, add the clipped value and the flag."""
    return df.withColumns({
        clean: clip_zero(raw),
        flag: F.coalesce(F.col(raw) < 0, F.lit(False)),
    })


def quality_flag(rules: list[tuple[Column, str]], default: str = "ok") -> Column:
    """Label of the first condition that holds."""
    labels = [F.when(cond, F.lit(label)) for cond, label in rules]
    return F.coalesce(*labels, F.lit(default))


def to_percent(c: Column | str) -> Column:
    """Shares up to 1 become percent; values above 1 already are."""
    c = _col(c)
    return F.when(c > 1, c).otherwise(c * 100)


def kelvin_to_celsius(c: Column | str) -> Column:
    return _col(c) - F.lit(273.15)


def per_million(value: Column | str, population: Column | str, metric: Column | str | None = None) -> Column:
    """Rate per million; an incidence per 100 000 is scaled instead."""
    value, population = _col(value), _col(population)
    rate = F.try_divide(value, F.nullif(population, F.lit(0).cast("double"))) * F.lit(1_000_000.0)
    if metric is None:
        return rate
    return F.when(_col(metric) == "incidence_per_100k", value * 10.0).otherwise(rate)


def growth(current: Column | str, prior: Column | str) -> Column:
    current, prior = _col(current), _col(prior)
    # greatest() skips nulls, so the guard keeps a missing prior missing.
    return F.when(prior.isNotNull(), (current - prior) / F.greatest(F.abs(prior), F.lit(1.0)))


def log_target(c: Column | str) -> Column:
    return F.log1p(_col(c))


def inverse_log_target(c: Column | str) -> Column:
    return F.greatest(F.expm1(_col(c)), F.lit(0.0))


def interval(prediction: Column | str) -> tuple[Column, Column]:
    """Reference band of 15 % around a prediction, never below zero."""
    p = _col(prediction)
    return F.when(p.isNotNull(), F.greatest(p * 0.85, F.lit(0.0))), p * 1.15


def error(prediction: Column | str, actual: Column | str) -> Column:
    return _col(prediction) - _col(actual)


def smape_term(actual: Column | str, predicted: Column | str) -> Column:
    a, p = _col(actual), _col(predicted)
    total = F.abs(a) + F.abs(p)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(p - a) * 2.0, total))


def risk_bucket(score: Column | str) -> Column:
    score = _col(score)
    labels = [F.when(score < bound, F.lit(label)) for bound, label in schema.RISK_BUCKETS]
    return F.coalesce(*labels, F.lit(schema.RISK_TOP))


def row_sum(columns: list[str]) -> Column:
    """Sum over the columns of a row; null only when all of them are null."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in columns))
    return F.when(F.coalesce(*(F.col(c) for c in columns)).isNotNull(), total)


def anomaly_label(role: Column | str, value: Column | str) -> Column:
    """Why a number is implausible for its role, null when it is fine."""
    role, value = _col(role), _col(value)
    return (
        F.when((role == "public_health") & (value < 0), "negative_public_health_or_population_value")
        .when((role == "latitude") & ~value.between(-90, 90), "latitude_out_of_range")
        .when((role == "longitude") & ~value.between(-180, 180), "longitude_out_of_range")
        .when((role == "humidity") & ~value.between(0, 100), "humidity_out_of_range")
    )


def ordered_bits(value: Column | str) -> Column:
    """The 64-bit pattern of a double as a whole number that orders like the value; both zeros give 0.

    Scaling by a power of two is exact, so exponent and mantissa come out of plain arithmetic. NaN is not expected.
    """
    value = _col(value)
    a = F.abs(value)
    guess = F.greatest(F.least(F.floor(F.log2(a)), F.lit(1023)), F.lit(-1022))
    half = F.floor((F.lit(52) - guess) / 2)
    mantissa = a * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), F.lit(52) - guess - half)
    # The logarithm may be off by one beside a power of two.
    high, low = mantissa >= F.lit(2.0**53), (mantissa < F.lit(2.0**52)) & (guess > -1022)
    mantissa = F.when(high, mantissa / 2).when(low, mantissa * 2).otherwise(mantissa)
    exponent = guess + F.when(high, 1).when(low, -1).otherwise(0)
    bits = (exponent + 1022) * F.lit(1 << 52) + mantissa.cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).when(a == F.lit(float("inf")), F.lit(2047 << 52)).otherwise(bits)
    return F.when(value < 0, -bits).otherwise(bits)
