"""Risk scores, series summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epitide import schema
from epitide.functions import measures
from epitide.operators import aggregates, windows


def latest_rows(features: DataFrame, by: str = "disease", keep: tuple[str, ...] = ()) -> DataFrame:
    """Latest row of each series with the columns a score reads."""
    columns = ["value", "cases_per_million", "growth_rate_7", "prediction_t_plus_7", "rolling_mean_7", *keep]
    return aggregates.latest_per_series(features, ["location_code", by], "date", columns)


def risk_score(latest: DataFrame, weights: tuple[float, float, float] = schema.RISK_WEIGHTS, by: str = "disease") -> DataFrame:
    """Latest rows (one per series) scored 0-100 within their disease.

    Rate, positive growth and forecast are min-max scaled per disease, weighted, and the composite is
    scaled again. A disease with fewer than two regions or a constant composite is not comparable.

    The scaling reads the latest rows several times; a caller that scores a large table stores them first.
    """
    rows = latest.withColumns({
        "recent_cases_per_million": F.coalesce("cases_per_million", "value"),
        "forecast_cases": F.coalesce("prediction_t_plus_7", "rolling_mean_7", "value"),
        "_growth": measures.clip_zero("growth_rate_7"),
    })
    scaled = windows.minmax(rows, [by], {"recent_cases_per_million": "_r", "_growth": "_g", "forecast_cases": "_f"})
    w_rate, w_growth, w_forecast = weights
    scored = scaled.withColumn("_composite", F.col("_r") * w_rate + F.col("_g") * w_growth + F.col("_f") * w_forecast)
    per = scored.groupBy(by).agg(
        F.count("*").alias("risk_region_count"), F.min("_composite").alias("_lo"), F.max("_composite").alias("_hi")
    )
    spread = F.abs(F.col("_hi") - F.col("_lo"))
    comparable = (F.col("risk_region_count") >= 2) & (spread > 1e-9 * F.greatest(F.abs("_hi"), F.abs("_lo")))
    score = F.round(F.try_divide(F.col("_composite") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 100.0, 2)
    return (
        scored.join(per, by)
        .withColumn("risk_comparable", comparable)
        .withColumn("risk_score", F.when(F.col("risk_comparable"), score).otherwise(F.lit(0.0)))
        .withColumn(
            "risk_level",
            F.when(F.col("risk_comparable"), measures.risk_bucket("risk_score")).otherwise(schema.RISK_NOT_COMPARABLE),
        )
        .drop("_r", "_g", "_f", "_growth", "_composite", "_lo", "_hi")
    )


def risk_score_simple(latest: DataFrame) -> DataFrame:
    """60 % forecast rate (relative to the maximum) plus 40 % absolute growth, all rows in order."""
    w_rate, w_growth = schema.RISK_WEIGHTS_SIMPLE
    rows = latest.withColumn("forecast_per_million", measures.per_million("rolling_mean_7", "population")).where(
        "forecast_per_million IS NOT NULL"
    )
    top = rows.agg(F.max("forecast_per_million")).scalar()
    rate = F.coalesce(F.try_divide(F.col("forecast_per_million"), F.nullif(F.col("_top"), F.lit(0.0))), F.col("forecast_per_million"))
    score = F.round((rate * w_rate + F.abs(F.coalesce("growth_rate_7", F.lit(0.0))) * w_growth) * 100.0, 2)
    return (
        rows.withColumn("_top", top)
        .withColumn("risk_score", score)
        .withColumn("risk_level", measures.risk_bucket("risk_score"))
        .drop("_top")
        .orderBy(F.desc("risk_score"), "location_code", "disease")
    )


def series_summaries(features: DataFrame) -> DataFrame:
    """Per series: range, latest values, last non-zero point, trailing zero run, stale flag."""
    by = ["location_code", "disease"]
    latest = features.groupBy(*by).agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count("*").alias("records"),
        F.max(F.struct("date", "value", "rolling_mean_7", "total_cases", "total_deaths", "metric", "source")).alias("_l"),
        F.count_if("has_weather").alias("weather_points"),
    )
    run = windows.trailing_run(features, by, "date", "value", "frequency").drop("latest_date")
    return latest.join(run, by).select(
        *by, "frequency", "start_date", "end_date", "records",
        F.col("_l.value").alias("current_value"),
        F.col("_l.rolling_mean_7").alias("current_rolling_value"),
        F.col("_l.total_cases").alias("current_total_cases"),
        F.col("_l.total_deaths").alias("current_total_deaths"),
        F.col("_l.metric").alias("metric"),
        F.col("_l.source").alias("source"),
        "last_nonzero_date", "last_nonzero_value", "trailing_zero_periods", "reporting_stale", "weather_points",
    )
