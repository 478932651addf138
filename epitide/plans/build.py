"""Raw files to silver, gold and serving tables, one stage after the other.

Each stage writes its tables and the next one reads them, so a stage can be rerun alone, lost
executors only cost their tasks, and joins are planned on measured file sizes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from epitide import schema
from epitide.functions import text
from epitide.operators import aggregates, reshape
from epitide.plans import cleaning, features as gold, forecasting, quality, risk, serving
from epitide.sources import readers, sinks

SERIES = ["location_code", "disease"]
REPORT_RENAMES = {"Province/State": "province_raw", "Country/Region": "country_region", "Last Update": "last_update_raw"}
PUBLISHED_COLUMNS = {
    "country": "string", "date": "string", "code": "string",
    **{c: "double" for c in ("total_cases", "new_cases", "new_cases_smoothed", "total_deaths", "new_deaths", "population", "population_density", "gdp_per_capita")},
}


@dataclass
class AnnualFile:
    """A file of one annual indicator; its value is the sum of the given columns, by default of all value columns."""

    path: str
    columns: list[str] | None = None


@dataclass
class RawFiles:
    """Where the raw files are; a source that is None is skipped. Years after current_year are flagged; a date bound of
    None sets no bound."""

    locations: str
    current_year: int
    mapping: str | None = None
    reports: str | None = None
    published: str | None = None
    weather_root: str | None = None
    population: str | None = None
    yearly_indicators: str | None = None
    hospital: str | None = None
    indicators_root: str | None = None
    pages: str | None = None
    page_files: DataFrame | None = None
    hourly: dict[str, str] = field(default_factory=dict)
    hourly_cities: dict[str, list[str]] = field(default_factory=dict)
    start: str | None = None
    end: str | None = None
    annual: AnnualFile | None = None
    annual_extra: dict[str, AnnualFile] = field(default_factory=dict)


def build_silver(spark: SparkSession, raw: RawFiles, out: str) -> dict[str, str]:
    """Clean every configured source; returns the path of each silver table."""
    written: dict[str, str] = {}

    def save(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        written[name] = f"{out}/silver/{name}"
        if partition_by:
            sinks.write_partitioned(df, written[name], partition_by)
        else:
            sinks.write_parquet(df, written[name])
        return readers.read_table(spark, written[name])

    catalog = save("locations", readers.location_catalog(readers.read_text_csv(spark, raw.locations)))
    codes = catalog.select("location_code")
    observations: list[DataFrame] = []

    if raw.reports and raw.mapping:
        mapping = readers.name_mapping(readers.read_csv(spark, raw.mapping, schema.NAME_MAPPING_SCHEMA))
        rows = readers.read_csv(spark, raw.reports, schema.CASE_REPORT_SCHEMA, REPORT_RENAMES)
        save("epidemic", cleaning.cumulative_reports(rows, mapping), ["year", "location_code"])
        validation = save("validation", cleaning.validation_series(rows, mapping))
    if raw.published:
        rows, rejected = readers.read_tolerant(spark, [raw.published], PUBLISHED_COLUMNS, ["country", "date", "code"])
        if rejected:
            raise ValueError(f"required columns are missing in {rejected}")
        published = save("published", cleaning.published_series(rows, codes, raw.start, raw.end))
        observations.append(published)
        if raw.reports and raw.mapping:  # two sources of one measure: compared, never summed
            save("reconciliation", quality.reconcile(published, validation, ["location_code", "date"], "total_cases"))
    if raw.annual:
        values = readers.read_annual_values(spark, raw.annual.path, raw.annual.columns).join(codes, "location_code", "left_semi")
        extra = {name: readers.read_annual_values(spark, f.path, f.columns) for name, f in raw.annual_extra.items()}
        observations.append(save("annual", cleaning.annual_indicators(values.withColumnRenamed("v", "value"), extra)))
    if raw.hospital:
        hospital = readers.read_text_csv(spark, raw.hospital)
        observations.append(save("hospital", cleaning.weekly_hospital(hospital)))
        if cleaning.share_columns(hospital):
            save("hospital_shares", cleaning.percent_columns(hospital).select("Week Ending Date", "Geographic aggregation", *cleaning.share_columns(hospital)))
    if raw.weather_root:
        weather = cleaning.weather_silver(readers.read_glob(spark, raw.weather_root, schema.WEATHER_SCHEMA))
        save("weather", weather.join(codes, "location_code", "left_semi"), ["year", "location_code"])
    if raw.population:
        sources = [cleaning.population_silver(readers.read_csv(spark, raw.population, schema.POPULATION_SCHEMA)).withColumn("source", F.lit("population table"))]
        if raw.yearly_indicators:
            yearly = readers.read_text_csv(spark, raw.yearly_indicators)
            numbers = [c for c in ("year", "population", "urban_population_ratio", "gdp_per_capita") if c in yearly.columns]
            sources.append(yearly.withColumns({c: text.parse_number(c) for c in numbers}))
        chosen = [s.join(codes.withColumnRenamed("location_code", "_code"), F.upper(F.trim("location_code")) == F.col("_code"), "left_semi") for s in sources]
        save("population", cleaning.yearly_population(chosen))
    if raw.indicators_root:
        layout = T.StructType([T.StructField(c, T.StringType()) for c in schema.INDICATOR_COLUMNS])
        rows = readers.read_latest(spark, raw.indicators_root, schema.INDICATOR_FILE_PATTERN, layout, [1, 2], 3)
        rows = rows.withColumn("source_file", F.col("file_name")).drop("file_name")
        indicators = save("indicators", cleaning.indicator_catalog(rows, codes, raw.current_year))
        observations.append(save("primary", cleaning.primary_observations(indicators, catalog)))
        save("auxiliary", cleaning.auxiliary_indicators(indicators))
        save("duplicate_audit", sinks.duplicate_audit(indicators))
    if raw.pages and raw.page_files is not None:
        pages = readers.read_json_lines(spark, raw.pages, schema.REPORT_PAGE_SCHEMA).where("_corrupt_record IS NULL")
        save("report_pages", cleaning.report_pages(pages, raw.page_files))
    if raw.hourly:
        # Only the city columns that are used are parsed.
        matrices = {
            name: readers.read_text_csv(spark, path).withColumn("at", text.parse_timestamp("datetime"))
            .select("at", *(F.col(f"`{c}`").try_cast("double").alias(c) for cs in raw.hourly_cities.values() for c in cs))
            for name, path in raw.hourly.items()
        }
        save("hourly_daily", cleaning.hourly_weather(matrices, "at", raw.hourly_cities, "daily"))
        save("hourly_annual", cleaning.hourly_weather(matrices, "at", raw.hourly_cities, "annual"))
    if observations:
        save("observations", cleaning.canonical(observations))
    tables = {part: (name, primary) for part, name, primary in LEDGER_TABLES if name in written}
    if tables:
        counted = {
            part: (readers.read_table(spark, written[name]), None, readers.read_table(spark, written[primary]) if primary in written else None)
            for part, (name, primary) in tables.items()
        }
        save("ledger", quality.ledger(counted))
    return written


#: Source of the ledger, its silver table, and the table of its curated series.
LEDGER_TABLES = (
    ("owid", "published", None), ("kaggle_covid", "epidemic", None), ("tuberculosis", "annual", None), ("respiratory", "hospital", None), ("weather", "weather", None),
    ("population", "population", None), ("china_cdc", "report_pages", None), ("who", "indicators", "primary"), ("historical_weather", "hourly_daily", None),
)


def build_gold(spark: SparkSession, silver: dict[str, str], out: str, population_mode: str = "asof") -> str:
    """Features of all observations, partitioned by year and location."""
    empty_weather = T.StructType([T.StructField("location_code", T.StringType()), T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in schema.WEATHER_VALUES)])
    empty_population = T.StructType([T.StructField("location_code", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("population", T.DoubleType())])

    def table(name: str, layout: T.StructType) -> DataFrame:
        return readers.read_table(spark, silver[name]) if name in silver else spark.createDataFrame([], layout)

    historical = None
    if "hourly_annual" in silver:
        rows = readers.read_table(spark, silver["hourly_annual"])
        values = [(F.col(c) if c in rows.columns else F.lit(None).cast("double")).alias(c) for c in schema.WEATHER_VALUES]
        historical = rows.select(
            "location_code", F.lit("annual").alias("frequency"), F.col("date").alias("join_date"), *values, "weather_match_level", F.lit("hourly archive").alias("weather_source")
        )
    obs = readers.read_table(spark, silver["observations"])
    rows = gold.build_features(
        obs, table("weather", empty_weather), table("population", empty_population), readers.read_table(spark, silver["locations"]), historical, population_mode
    )
    path = f"{out}/gold/features"
    sinks.write_partitioned(rows, path, ["year", "location_code"])
    return path


def train_trees(features: DataFrame, out: str, trees: int = 60) -> tuple[DataFrame | None, str | None]:
    """Boosted trees on the daily eligible rows: scored rows, or the reason why there is no model."""
    columns = [c for c in schema.FEATURE_COLUMNS]
    rows = features.where("model_eligible").dropna(subset=list(schema.REQUIRED_FEATURES))
    rows = forecasting.as_numeric(rows, columns).withColumn("target_log", F.log1p("target_t_plus_7"))
    split = forecasting.time_split(rows)
    try:
        forecasting.require_partitions(split)
    except ValueError as reason:
        return None, str(reason)
    train = split.where("split = 'train'")
    model = forecasting.fit_gbt(train, forecasting.usable_numeric(train, columns), trees)
    sinks.save_model(model, f"{out}/models/gbt")
    scored = forecasting.gbt_predict(model, rows.drop("target_log"))
    path = f"{out}/gold/predictions"
    sinks.write_parquet(scored.select(*SERIES, "date", "prediction_gbt"), path)
    return readers.read_table(features.sparkSession, path), None


def build_serving(spark: SparkSession, gold_path: str, silver: dict[str, str], out: str, main_disease: str = "COVID-19", trees: int = 0) -> dict[str, str]:
    """Evaluate models, choose one per disease, and write every dashboard document."""
    features = readers.read_table(spark, gold_path)
    rows = forecasting.baselines(features)
    models = ["naive_last_value", "moving_average"]
    metrics = forecasting.baseline_comparison(features).withColumn("skipped_because", F.lit(None).cast("string"))
    if trees:
        predicted, reason = train_trees(features, out, trees)
        if predicted is not None:
            rows = rows.join(predicted, [*SERIES, "date"], "left")
            models.append("gbt")
            test = forecasting.time_split(rows.where("prediction_gbt IS NOT NULL AND target_t_plus_7 IS NOT NULL"), by=["disease"]).where("split = 'test'")
            learned = aggregates.regression_metrics(test.withColumn("model", F.lit("gbt")), "target_t_plus_7", "prediction_gbt", ["disease", "model"])
            metrics = metrics.unionByName(learned, allowMissingColumns=True)
        else:
            skipped = spark.createDataFrame([("gbt", reason)], "model string, skipped_because string")
            metrics = metrics.unionByName(skipped, allowMissingColumns=True)
    path = f"{out}/gold/scored"
    sinks.write_partitioned(forecasting.select_best(rows, metrics, models), path, ["year"])
    scored = readers.read_table(spark, path)
    latest_path = f"{out}/gold/latest"
    sinks.write_parquet(risk.latest_rows(scored, keep=("metric", "latitude", "longitude", "quality_flag")), latest_path)
    risk_rows = risk.risk_score(readers.read_table(spark, latest_path))
    matched = scored.where("has_weather").select(
        "date", *SERIES, "frequency", "metric", "temperature_mean", "relative_humidity_mean", "precipitation_sum", "new_cases_smoothed", "weather_match_level", "weather_source"
    )
    documents = {
        "overview": serving.overview(scored, main_disease, risk_rows, metrics.where("skipped_because IS NULL")),
        "series": risk.series_summaries(scored),
        "trend": serving.trend_documents(scored, None),
        "risk_map": risk_rows,
        "rankings": reshape.rankings(risk_rows, serving.RANKINGS, SERIES),
        "predictions": forecasting.prediction_export(scored, models, None),
        "model_metrics": metrics,
        "best_models": aggregates.best_model(metrics.where("skipped_because IS NULL"), ["disease"]),
        "data_quality": quality.serving_report(scored),
        "options": serving.options(scored, models, metrics.where("skipped_because IS NULL")),
        "option_pages": serving.option_pages(scored),
        "data_quality_by_source": quality.serving_report_by(scored, ["source", "frequency"]),
        "weather_rows": matched,
        "weather_correlation": serving.weather_correlation(scored),
        "disease_share": serving.disease_share(scored),
        "model_coverage": quality.model_rows(quality.model_coverage(scored), metrics),
        "feature_join": gold.join_report(scored),
        "statistics": aggregates.statistics(scored, list(schema.YEARLY_KEYS), schema.YEARLY_STATISTICS),
    }
    if "ledger" in silver:
        documents["source_status"] = quality.source_status(quality.named_sources(readers.read_table(spark, silver["ledger"])))
    if "indicators" in silver:
        documents["indicator_summary"] = aggregates.indicator_summary(readers.read_table(spark, silver["indicators"]))
    written = {}
    for name, df in documents.items():
        written[name] = f"{out}/serving/{name}"
        sinks.write_documents(df, written[name])
    return written


def export_csv(spark: SparkSession, silver: dict[str, str], out: str) -> dict[str, str]:
    """Every silver table as CSV; nested columns are not part of the silver layer."""
    paths = {name: f"{out}/csv/{name}" for name in silver}
    for name, path in paths.items():
        sinks.write_csv(readers.read_table(spark, silver[name]), path)
    return paths


def build_all(spark: SparkSession, raw: RawFiles, out: str, trees: int = 60) -> dict[str, dict[str, str] | str]:
    silver = build_silver(spark, raw, out)
    gold_path = build_gold(spark, silver, out)
    return {"silver": silver, "gold": gold_path, "serving": build_serving(spark, gold_path, silver, out, trees=trees), "csv": export_csv(spark, silver, out)}
