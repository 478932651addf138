"""Dashboard questions as DataFrame-returning functions over the gold table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from epitide import schema
from epitide.functions import calendar, measures
from epitide.operators import aggregates, reshape, windows
from epitide.plans import quality, risk

SERIES = ["location_code", "disease"]
BASELINE_MODELS = {"naive_last_value": "value", "moving_average": "rolling_mean_7", "naive_rolling_7": "rolling_mean_7"}


class ValidationError(ValueError):
    """An argument of a question is not usable."""


def parse_bounds(start: str | None, end: str | None) -> tuple[date | None, date | None]:
    def one(value: str | None, name: str) -> date | None:
        if not value:
            return None
        try:
            return date.fromisoformat(value)
        except ValueError as exc:
            raise ValidationError(f"{name} must be YYYY-MM-DD") from exc

    lo, hi = one(start, "start"), one(end, "end")
    if lo and hi and lo > hi:
        raise ValidationError("start must not be after end")
    return lo, hi


def resolve_location(catalog: DataFrame, value: str) -> str:
    """Code or name, any case, to the code; one point lookup."""
    wanted = F.lit(value.strip().upper())
    by_code = F.upper("location_code") == wanted
    hit = (
        catalog.where(by_code | (F.upper(F.trim("location")) == wanted))
        .select(F.upper("location_code").alias("code"), F.when(by_code, 0).otherwise(1).alias("rank"))
        .orderBy("rank", "code")
        .first()
    )
    if hit is None:
        raise ValidationError(f"unknown location: {value}")
    return hit["code"]


def resolve_locations(requests: DataFrame, catalog: DataFrame, column: str) -> DataFrame:
    """The same lookup for a table of requests; unresolved ones keep a null code."""
    keys = reshape.union_all([
        catalog.select(F.upper("location_code").alias("_k"), F.lit(0).alias("_rank"), F.upper("location_code").alias("code")),
        catalog.select(F.upper(F.trim("location")).alias("_k"), F.lit(1).alias("_rank"), F.upper("location_code").alias("code")),
    ])
    best = windows.keep_latest(keys, ["_k"], [F.col("_rank"), F.col("code")]).drop("_rank")
    return requests.withColumn("_k", F.upper(F.trim(column))).join(best, "_k", "left").drop("_k")


def filter_series(
    df: DataFrame, location: str | None = None, disease: str | None = None, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Rows of a location, disease and date window; rows without a date are dropped."""
    lo, hi = parse_bounds(start, end)
    out = df.where("date IS NOT NULL")
    if location:
        out = out.where(F.col("location_code") == location.strip().upper())
    if disease:
        out = out.where(F.lower("disease") == disease.strip().lower())
    if lo:
        out = out.where(F.col("date") >= F.lit(lo))
    if hi:
        out = out.where(F.col("date") <= F.lit(hi))
    return out


def model_prediction(df: DataFrame, model: str) -> tuple[Column, Column, Column]:
    """Prediction of the selected model; only learned models carry an interval."""
    none = F.lit(None).cast("double")
    if model in BASELINE_MODELS:
        return F.col(BASELINE_MODELS[model]), none, none
    name = f"prediction_{model}"
    if name not in df.columns:
        raise ValidationError(f"unknown model: {model}")
    lower, upper = measures.interval(name)
    return F.col(name), lower, upper


def _risk_summary(risk_rows: DataFrame) -> DataFrame:
    """Per disease: regions compared, whether they are comparable, and the high-risk ones if so."""
    per_disease = risk_rows.groupBy("disease").agg(
        F.count("*").alias("risk_comparison_regions"),
        F.bool_or("risk_comparable").alias("_any"),
        F.count_if(F.col("risk_level") == schema.RISK_TOP).alias("_high"),
    )
    comparable = (F.col("risk_comparison_regions") >= 2) & F.col("_any")
    return per_disease.select(
        "disease", "risk_comparison_regions", comparable.alias("risk_comparable"),
        F.when(comparable, F.col("_high")).alias("high_risk_regions"),
    )


def overview(features: DataFrame, main_disease: str, risk_rows: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Totals over all series plus a snapshot of each location's latest row of the main disease, its risk summary and its
    best model."""
    latest = aggregates.latest_per_series(
        features.where(F.col("disease") == main_disease), ["location_code"], "date", ["total_cases", "total_deaths", "value"]
    )
    snapshot = latest.agg(
        F.sum("total_cases").alias("current_total_cases"),
        F.sum("total_deaths").alias("current_total_deaths"),
        F.sum("value").alias("current_new_cases"),
    )
    totals = features.agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count_distinct("location_code").alias("regions"),
        F.count_distinct("disease").alias("diseases"),
        F.count("*").alias("valid_records"),
        aggregates.completeness(features, list(schema.REQUIRED_OBSERVATION)).alias("data_completeness"),
    )
    out = aggregates.attach(totals, snapshot)
    if risk_rows is not None:
        main = _risk_summary(risk_rows.where(F.col("disease") == main_disease)).drop("disease")
        one = main.agg(  # no row where the disease has none
            F.coalesce(F.max("risk_comparison_regions"), F.lit(0)).alias("risk_comparison_regions"),
            F.coalesce(F.bool_or("risk_comparable"), F.lit(False)).alias("risk_comparable"), F.max("high_risk_regions").alias("high_risk_regions"),
        )
        out = aggregates.attach(out, one)
    if metrics is not None:
        best = aggregates.best_model(metrics.where(F.col("disease") == main_disease), ["disease"])
        out = aggregates.attach(out, best.agg(F.max("best_model").alias("best_model"), F.max("best_mae").alias("best_model_mae")))
    return out


def overview_selected(
    features: DataFrame, risk_rows: DataFrame, best: DataFrame, location: str | None = None, disease: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Latest point, last non-zero point, stale flag, best model and high-risk count per series."""
    points = filter_series(features, location, disease, start, end)
    latest = points.groupBy(*SERIES).agg(
        F.min("date").alias("start_date"), F.max(F.struct("date", "value", "rolling_mean_7", "total_cases")).alias("_l")
    ).select(
        *SERIES, "start_date", F.col("_l.date").alias("latest_date"), F.col("_l.value").alias("current_new_cases"),
        F.col("_l.rolling_mean_7").alias("current_rolling_value"), F.col("_l.total_cases").alias("current_total_cases"),
    )
    run = windows.trailing_run(points, SERIES, "date", "value", "frequency").drop("latest_date")
    return latest.join(run, SERIES).join(_risk_summary(risk_rows), "disease", "left").join(best, "disease", "left")


def trend(
    features: DataFrame, location: str | None, disease: str | None, start: str | None = None, end: str | None = None,
    model: str = "moving_average",
) -> DataFrame:
    """Points of the selected series with the selected model's prediction."""
    points = filter_series(features, location, disease, start, end)
    prediction, lower, upper = model_prediction(points, model)
    return points.select(
        *SERIES, "date", calendar.target_date("date", "frequency", "horizon_steps").alias("forecast_target_date"),
        F.col("value").alias("actual"), F.col("rolling_mean_7").alias("rolling_7"), F.lit(model).alias("model"),
        prediction.alias("prediction"), lower.alias("lower"), upper.alias("upper"), "growth_rate_7", "target_t_plus_7",
    )


def trend_profile(features: DataFrame, location: str | None, disease: str | None, start: str | None = None, end: str | None = None) -> DataFrame:
    points = filter_series(features, location, disease, start, end).where("frequency = 'daily'")
    return quality.reporting_profile(points, SERIES, "date", "value")


def predictions(
    features: DataFrame, location: str | None = None, disease: str | None = None, start: str | None = None,
    end: str | None = None, model: str = "moving_average",
) -> DataFrame:
    rows = filter_series(features, location, disease, start, end).where("target_t_plus_7 IS NOT NULL")
    name = f"prediction_{'moving_average' if model == 'naive_rolling_7' else model}"
    if name not in rows.columns:
        raise ValidationError(f"unknown model: {model}")
    return rows.select(
        *SERIES, "date", F.lit(model).alias("model"), F.col("target_t_plus_7").alias("actual_t_plus_7"),
        F.col(name).alias("prediction"), measures.error(name, "target_t_plus_7").alias("error"),
    )


def weather_correlation(
    features: DataFrame, location: str | None = None, disease: str | None = None, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Correlation of cases with temperature and humidity per series.

    A series without a matched row in the window falls back to its full range; both ranges are
    aggregated in the same pass.
    """
    lo, hi = parse_bounds(start, end)
    rows = filter_series(features, location, disease).where(
        "temperature_mean IS NOT NULL AND relative_humidity_mean IS NOT NULL AND new_cases_smoothed IS NOT NULL"
    )
    inside = F.lit(True)
    if lo:
        inside = inside & (F.col("date") >= F.lit(lo))
    if hi:
        inside = inside & (F.col("date") <= F.lit(hi))

    def stats(prefix: str, keep: Column) -> list[Column]:
        t, h, y = (F.when(keep, F.col(c)) for c in ("temperature_mean", "relative_humidity_mean", "new_cases_smoothed"))

        def corr(x: Column) -> Column:
            spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
            return F.when(F.count_if(keep) >= 3, F.round(F.try_divide(F.covar_pop(x, y), spread), 4))

        day = F.when(keep, F.col("date"))
        return [
            F.count_if(keep).alias(f"{prefix}_n"), corr(t).alias(f"{prefix}_t"), corr(h).alias(f"{prefix}_h"),
            F.min(day).alias(f"{prefix}_from"), F.max(day).alias(f"{prefix}_to"),
        ]

    both = rows.groupBy(*SERIES).agg(*stats("w", inside), *stats("f", F.lit(True)))
    fallback = (F.col("w_n") == 0) & F.lit(bool(lo or hi))

    def choose(name: str) -> Column:
        return F.when(fallback, F.col(f"f_{name}")).otherwise(F.col(f"w_{name}"))

    return both.select(
        *SERIES, choose("n").alias("sample_size"), choose("t").alias("temperature_correlation"),
        choose("h").alias("humidity_correlation"), fallback.alias("fallback_used"),
        choose("from").alias("matched_start"), choose("to").alias("matched_end"),
    )


RANKINGS = {"risk": "risk_score", "growth": "growth_rate_7", "forecast": "forecast_cases"}


def risk_map(features: DataFrame, disease: str | None = None) -> DataFrame:
    """Scored regions; scores are per disease, so one disease is chosen before anything is computed."""
    rows = features.where(F.lower("disease") == disease.strip().lower()) if disease else features
    return risk.risk_score(risk.latest_rows(rows))


def rankings(features: DataFrame, disease: str | None = None, n: int | None = None) -> DataFrame:
    """All regions by risk, growth and forecast; with n, the first n of each."""
    rows = risk_map(features, disease)
    return reshape.rankings(rows, RANKINGS, SERIES, n)


def options(features: DataFrame, models: list[str], metrics: DataFrame | None = None) -> DataFrame:
    """Per disease: number of locations, range, labels, models and the default model (the best one, else the first).

    The locations of a disease come in pages, see `option_pages`.
    """
    per_series = _series_ranges(features)
    out = per_series.groupBy("disease").agg(
        F.count("*").alias("location_count"), F.min("full_start").alias("start"), F.max("full_end").alias("end"),
        *(F.min(c).alias(c) for c in ("frequency", "metric", "metric_label")),
    ).withColumns({"default_start": F.col("start"), "default_end": F.col("end"), "models": F.array(*(F.lit(m) for m in models))})
    first = F.lit(models[0])
    if metrics is None:
        return out.withColumn("default_model", first)
    best = aggregates.best_model(metrics, ["disease"]).select("disease", "best_model")
    known = F.when(F.array_contains("models", F.col("best_model")), F.col("best_model"))
    return out.join(best, "disease", "left").withColumn("default_model", F.coalesce(known, first)).drop("best_model")


def option_pages(features: DataFrame, size: int = 500) -> DataFrame:
    """The locations of each disease with their ranges, in numbered pages of at most `size` locations."""
    rows = _series_ranges(features).withColumns({"default_start": F.col("full_start"), "default_end": F.col("full_end")})
    columns = ["full_start", "full_end", "default_start", "default_end", "last_nonzero_date"]
    return reshape.pages(rows, ["disease"], "location_code", columns, size)


def _series_ranges(features: DataFrame) -> DataFrame:
    """One row per series, never the observations."""
    return features.groupBy("disease", "location_code").agg(
        F.min("date").alias("full_start"), F.max("date").alias("full_end"),
        F.max(F.when(F.abs("value") > 1e-9, F.col("date"))).alias("last_nonzero_date"),
        *(F.min(c).alias(c) for c in ("frequency", "metric", "metric_label")),
    )


def disease_share(features: DataFrame) -> DataFrame:
    return features.groupBy("disease").agg(
        F.count("*").alias("record_count"), F.count_distinct("location_code").alias("location_count"),
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
    )


def trend_documents(features: DataFrame, n: int | None) -> DataFrame:
    """Nested series documents of all points, or of the last n; a series is bounded by the calendar."""
    recent = windows.last_n(features, SERIES, [F.desc("date")], n) if n is not None else features
    return reshape.series_documents(
        recent, SERIES, ["frequency", "metric", "source"], ["date", "value", "rolling_mean_7", "growth_rate_7", "target_t_plus_7"], "date"
    )


def history_with_predictions(history: DataFrame, predicted: DataFrame) -> DataFrame:
    """Observed points with their predictions in one join."""
    rows = history.join(predicted, [*SERIES, "date"], "left")
    lower, upper = measures.interval("prediction")
    return rows.withColumns({
        "lower": lower, "upper": upper, "prediction_error": measures.error("prediction", "target_t_plus_7"),
    })
