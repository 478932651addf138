"""Observation table to gold features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epitide import schema
from epitide.functions import calendar, measures
from epitide.operators import joins, windows

SERIES = ["location_code", "disease"]


def check_no_leak(columns: tuple[str, ...] = schema.FEATURE_COLUMNS) -> None:
    leaked = [c for c in columns if c.startswith("target") or "plus_7" in c]
    if leaked:
        raise ValueError(f"feature columns must not hold the target: {leaked}")


def _population(obs: DataFrame, population: DataFrame, mode: str) -> DataFrame:
    cols = ["population", "urban_population_ratio", "gdp_per_capita", "density_per_km2"]
    missing = [c for c in cols if c not in population.columns]
    dim = population.withColumns({c: F.lit(None).cast("double") for c in missing}).select("location_code", "year", *cols)
    if mode == "same_year":
        joined = obs.join(dim, ["location_code", "year"], "left")
    else:
        joined = joins.asof_backward(
            obs.withColumnRenamed("year", "obs_year"), dim, ["location_code"], F.col("obs_year"), "year", cols
        ).withColumnRenamed("obs_year", "year").drop("matched_year")
    return joined.withColumns({
        "population": F.coalesce("population", "source_population"),
        "density_per_km2": F.coalesce("density_per_km2", "source_density_per_km2"),
        "gdp_per_capita": F.coalesce("gdp_per_capita", "source_gdp_per_capita"),
    })


def frequency_label(kind: str) -> Column:
    """Shown name of the rolling window or of the horizon of a row's frequency."""
    out = F.lit(None).cast("string")
    for frequency, labels in schema.FREQUENCY_LABELS.items():
        out = F.when(F.col("frequency") == frequency, labels[kind]).otherwise(out)
    return out


def build_features(
    obs: DataFrame, weather: DataFrame, population: DataFrame, catalog: DataFrame,
    historical: DataFrame | None = None, population_mode: str = "asof", weather_source: str = "daily weather",
) -> DataFrame:
    """Multi-frequency features: covariates at the series' own frequency, exact-date target.

    Window columns come first: they need one shuffle on the series; the covariate joins follow and only
    add columns.
    """
    check_no_leak()
    rows = obs.where("date IS NOT NULL AND location_code IS NOT NULL AND disease IS NOT NULL AND value IS NOT NULL")
    rows = rows.withColumn("year", F.year("date"))
    rows = windows.frequency_features(rows, SERIES)
    rows = joins.join_by_period(
        rows, weather, ["location_code"], list(schema.WEATHER_VALUES), overrides=historical, source=weather_source
    )
    rows = _population(rows, population, population_mode)
    rows = joins.enrich_location(rows, catalog)
    rows = rows.withColumn("has_weather", F.col("temperature_mean").isNotNull() & F.col("relative_humidity_mean").isNotNull())
    return rows.withColumns({
        "cases_per_million": measures.per_million("value", "population", "metric"),
        "deaths_per_million": measures.per_million("new_deaths", "population"),
        **calendar.calendar_features("date"),
        "rolling_label": frequency_label("rolling_label"),
        "forecast_horizon_label": frequency_label("forecast_horizon_label"),
        "model_eligible": (F.col("frequency") == "daily") & (F.col("disease") == "COVID-19"),
    })


def build_row_features(obs: DataFrame, weather: DataFrame, population: DataFrame, horizon: int = 7) -> DataFrame:
    """Daily form: row lags, as-of population, target a fixed number of rows ahead, complete rows only.

    Input columns: location_code, disease, date, value, smoothed, new_deaths.
    """
    check_no_leak()
    rows = obs.join(weather.drop("year"), ["location_code", "date"], "left").withColumn("obs_year", F.year("date"))
    rows = joins.asof_backward(rows, population, ["location_code"], F.col("obs_year"), "year", ["population"])
    rows = windows.lags(rows, SERIES, "date", "smoothed")
    rows = windows.rolling_mean(rows, SERIES, "date", "value")
    rows = windows.rolling_std(rows, SERIES, "date", "value")
    rows = windows.lead_target(rows, SERIES, "date", "smoothed", horizon, "target_t_plus_7")
    rows = rows.withColumns({
        "growth_rate_1": measures.growth("smoothed", "lag_1"),
        "growth_rate_7": measures.growth("smoothed", "lag_7"),
        "cases_per_million": measures.per_million("value", "population"),
        "deaths_per_million": measures.per_million("new_deaths", "population"),
        "target_log": measures.log_target("target_t_plus_7"),
        **calendar.calendar_features("date"),
    })
    return rows.dropna(subset=list(schema.REQUIRED_FEATURES))


def join_report(features: DataFrame) -> DataFrame:
    """Matched and unmatched rows by match level and source."""
    return features.groupBy("weather_match_level", "weather_source").agg(
        F.count("*").alias("rows"),
        F.count_if("has_weather").alias("matched_rows"),
        F.count_if(~F.col("has_weather")).alias("unmatched_rows"),
    )


def join_totals(features: DataFrame) -> DataFrame:
    matched: Column = F.col("has_weather").cast("double")
    return features.agg(
        F.count("*").alias("feature_rows"),
        F.count_distinct("location_code").alias("location_count"),
        F.count_distinct("disease").alias("disease_count"),
        F.count_if("has_weather").alias("weather_matched_rows"),
        F.count_if(~F.col("has_weather")).alias("weather_unmatched_rows"),
        F.round(F.avg(matched), 6).alias("weather_match_rate"),
        F.count_if(F.col("population").isNull()).alias("population_unmatched_rows"),
    )
