"""Raw tables to silver tables and the canonical observation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epitide import schema
from epitide.functions import calendar, measures, records, text
from epitide.operators import aggregates, joins, reshape, windows


def observation(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Project onto the canonical observation columns; what a source lacks is null."""
    types = {
        "date": "date", "year": "int", "period_days": "int", "is_negative_case_correction": "boolean",
        "is_negative_death_correction": "boolean",
    }
    text_columns = {"location_code", "location", "disease", "frequency", "metric", "metric_label", "source", "quality_flag"}
    out = []
    for name in schema.OBSERVATION_COLUMNS:
        kind = types.get(name, "string" if name in text_columns else "double")
        value = columns.get(name, F.col(name) if name in df.columns else F.lit(None))
        value = F.lit(value) if not isinstance(value, Column) else value
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def cumulative_reports(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cumulative case reports to one row per country and day.

    Input columns: SNo, ObservationDate, province_raw, country_region, last_update_raw, Confirmed,
    Deaths, Recovered. Mapping columns: name, standard_name, mapped_code.
    """
    totals = ["total_cases", "total_deaths", "total_recovered"]
    parsed = raw.select(
        "SNo",
        text.parse_date("ObservationDate", "M/d/yyyy").alias("date"),
        text.blank_to_null("province_raw").alias("province"),
        F.trim("country_region").alias("country_region"),
        text.parse_timestamp("last_update_raw").alias("last_update_ts"),
        F.col("Confirmed").cast("double").alias("total_cases"),
        F.col("Deaths").cast("double").alias("total_deaths"),
        F.col("Recovered").cast("double").alias("total_recovered"),
    ).where("date IS NOT NULL")
    unique = windows.keep_latest(
        parsed, ["country_region", "province", "date"],
        [F.col("last_update_ts").desc_nulls_last(), F.col("SNo").desc_nulls_last()],
    )
    # Levels are resolved per raw country name first; the mapping joins the much smaller result.
    levels = aggregates.split_levels(unique, ["country_region", "date"], "province", "country_region", totals)
    resolved = aggregates.resolve_levels(levels, totals)
    mapped = joins.map_names(resolved, mapping, "country_region")
    per_code = aggregates.merge_names(mapped, ["location_key", "location_code", "date"], totals, "location")
    daily = windows.diff_cumulative(
        per_code, ["location_key"], "date", {"total_cases": "new_cases_raw", "total_deaths": "new_deaths_raw"}
    )
    daily = measures.clip_negative(daily, "new_cases_raw", "new_cases_clean", "is_negative_case_correction")
    daily = measures.clip_negative(daily, "new_deaths_raw", "new_deaths_clean", "is_negative_death_correction")
    return daily.withColumn("year", F.year("date"))


def weather_silver(raw: DataFrame) -> DataFrame:
    """Daily weather files to one typed row per (location, date), the latest download kept."""
    numbers = ["latitude", "longitude", *schema.WEATHER_VALUES]
    parsed = raw.select(
        text.parse_date(F.col("date").cast("string"), "yyyy-MM-dd").alias("date"),
        F.trim("location").alias("location"),
        text.iso3("location_code").alias("location_code"),
        F.trim("representative_city").alias("representative_city"),
        *(F.col(c).try_cast("double").alias(c) for c in numbers),
        F.col("source"),
        text.parse_timestamp("downloaded_at").alias("collected_at"),
    ).where("location_code IS NOT NULL AND date IS NOT NULL")
    order = [F.col("collected_at").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in schema.WEATHER_VALUES)]
    return windows.keep_latest(parsed, ["location_code", "date"], order).withColumn("year", F.year("date"))


def population_silver(raw: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Wide population table to one row per (code, year); no year is filled in."""
    columns = reshape.columns_matching(raw, r"\d{4} Population")
    if years:
        columns = [c for c in columns if int(c[:4]) in years]
    base = raw.select(
        F.trim("Country/Territory").alias("location"),
        text.iso3("CCA3").alias("location_code"),
        F.col("Density (per km²)").try_cast("double").alias("density_per_km2"),
        F.col("Growth Rate").try_cast("double").alias("growth_rate"),
        *columns,
    ).where("location_code IS NOT NULL")
    long = reshape.wide_to_long(
        base, ["location_code", "location", "density_per_km2", "growth_rate"], columns, "year", "population", r"(\d{4})"
    )
    return windows.keep_latest(long, ["location_code", "year"], [F.col("population").desc_nulls_last(), F.col("location")])


def published_series(raw: DataFrame, locations: DataFrame | None, start: str | None, end: str | None, disease: str = "COVID-19", source: str = "published daily series") -> DataFrame:
    """Published daily series of the given locations (all if None) to observations; a missing new-case value comes from
    the total. None as start or end sets no bound."""
    rows = raw.select(
        text.parse_date(F.col("date").cast("string"), "yyyy-MM-dd").alias("date"),
        text.iso3("code").alias("location_code"),
        F.trim("country").alias("location"),
        *(
            (F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")).alias(c)
            for c in ("total_cases", "new_cases", "new_cases_smoothed", "total_deaths", "new_deaths",
                      "population", "population_density", "gdp_per_capita")
        ),
    ).where(F.col("location_code").isNotNull() & F.col("date").isNotNull())
    rows = rows.where(F.col("date") >= F.lit(start)) if start else rows
    rows = rows.where(F.col("date") <= F.lit(end)) if end else rows
    if locations is not None:
        rows = rows.join(locations.select("location_code").distinct(), "location_code", "left_semi")
    rows = windows.keep_latest(
        rows, ["location_code", "date"], [F.col("total_cases").desc_nulls_last(), F.col("new_cases").desc_nulls_last()]
    )
    rows = windows.published_or_difference(rows, ["location_code"], "date", "new_cases", "total_cases", "new_cases_raw")
    rows = measures.clip_negative(rows, "new_cases_raw", "value", "is_negative_case_correction")
    rows = rows.withColumn("_deaths", F.col("new_deaths"))
    rows = measures.clip_negative(rows, "_deaths", "new_deaths", "is_negative_death_correction")
    return observation(
        rows,
        disease=disease, frequency="daily", period_days=1, metric="new_cases", metric_label="日新增病例",
        published_smoothed=F.col("new_cases_smoothed"), year=F.year("date"), source=source,
        quality_flag=measures.quality_flag([(F.col("is_negative_case_correction"), "negative_revision_clipped")]),
        source_population=F.col("population"), source_density_per_km2=F.col("population_density"),
        source_gdp_per_capita=F.col("gdp_per_capita"),
    )


def validation_series(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cumulative reports for cross-checking: provinces win over the national row."""
    rows = raw.select(
        "SNo",
        text.parse_date("ObservationDate", "M/d/yyyy").alias("date"),
        text.blank_to_null("province_raw").alias("province"),
        F.trim("country_region").alias("country_region"),
        text.parse_timestamp("last_update_raw").alias("last_update_ts"),
        *(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in ("Confirmed", "Deaths", "Recovered")),
    ).where("date IS NOT NULL")
    coded = mapping.where("mapped_code IS NOT NULL").select(F.col("name").alias("country_region"), F.col("mapped_code").alias("location_code"))
    rows = windows.keep_latest(
        rows.join(coded, "country_region"), ["country_region", "province", "date"],
        [F.col("last_update_ts").desc_nulls_last(), F.col("SNo").desc_nulls_last()],
    )
    return aggregates.province_wins(
        rows, ["date", "country_region"], "province", ["location_code", "date"],
        {"Confirmed": "total_cases", "Deaths": "total_deaths", "Recovered": "total_recovered"},
    )


def annual_indicators(base: DataFrame, extra: dict[str, DataFrame], disease: str = "Tuberculosis", source: str = "annual indicators") -> DataFrame:
    """Annual indicator files to one table: `base` has location_code, location, year, value; each extra
    table has location_code, year, v. One union and one pivot replace a join per file."""
    keys = ["location_code", "year"]
    wide = joins.stack_indicators({name: f.select(*keys, "v") for name, f in extra.items()}, keys, ["v"])
    rows = base.where("year IS NOT NULL AND value IS NOT NULL").join(wide, keys, "left")
    core = observation(
        rows, disease=disease, date=calendar.year_end("year"), frequency="annual", period_days=365,
        metric="incidence_per_100k", metric_label="估计发病率（每10万人）", source=source, quality_flag="ok",
        is_negative_case_correction=F.lit(False), is_negative_death_correction=F.lit(False),
        **({"total_deaths": F.col("deaths_all_ages"), "new_deaths": F.col("deaths_all_ages")} if "deaths_all_ages" in extra else {}),
    )
    names = list(extra)
    return core.join(rows.select(*keys, *names), keys, "left") if names else core


def weekly_hospital(raw: DataFrame, country: str = "USA", location: str = "United States") -> DataFrame:
    """Weekly hospital table to one series per disease; only the national row is used."""
    national = raw.where(F.col("Geographic aggregation") == country).withColumn(
        "date", text.parse_date(F.col("Week Ending Date").cast("string"), "yyyy-MM-dd", "M/d/yyyy")
    ).where("date IS NOT NULL")
    numbers = [c for c in raw.columns if c not in ("Week Ending Date", "Geographic aggregation")]
    national = windows.keep_latest(national, ["date"], [F.col(c).desc_nulls_last() for c in numbers])
    definitions = []
    for disease, admissions, hospitalised in schema.HOSPITAL_SERIES:
        if admissions in raw.columns:
            stay = F.col(hospitalised).try_cast("double") if hospitalised in raw.columns else F.lit(None).cast("double")
            definitions.append((disease, {"raw": F.col(admissions).try_cast("double"), "hospitalized_patients": stay}))
    rows = reshape.split_measures(national, ["date"], definitions, "disease").where("raw IS NOT NULL")
    rows = measures.clip_negative(rows, "raw", "value", "is_negative_case_correction")
    core = observation(
        rows, location_code=country, location=location, year=F.year("date"), frequency="weekly", period_days=7,
        metric="hospital_admissions", metric_label="每周新增住院入院人数", is_negative_death_correction=F.lit(False),
        source="weekly hospital table",
        quality_flag=measures.quality_flag([(F.col("is_negative_case_correction"), "negative_revision_clipped")]),
    )
    return core


def share_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("Percent ")]


def percent_columns(df: DataFrame) -> DataFrame:
    """Occupancy shares of the hospital table as percent."""
    return df.withColumns({c: measures.to_percent(F.col(c).try_cast("double")) for c in share_columns(df)})


def yearly_population(
    sources: list[DataFrame], grid: tuple[int | None, int | None] = (1990, 2025), back_fill: bool = False,
    interpolated_source: str = "Interpolated between Kaggle/World Bank population years",
) -> DataFrame:
    """Sources in rising precedence to one row per (code, year), gaps filled between known years only.

    Each source has location_code, location, year, population and may have urban_population_ratio,
    gdp_per_capita, density_per_km2, growth_rate, source. Slow attributes are carried forward;
    `back_fill` also copies them backwards (uses later values).
    """
    optional = {"urban_population_ratio": "double", "gdp_per_capita": "double", "density_per_km2": "double", "growth_rate": "double", "source": "string"}

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(
            F.upper(F.trim("location_code")).alias("location_code"), "location",
            F.col("year").cast("int").alias("year"), F.col("population").cast("double").alias("population"),
            *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()),
        )

    merged = joins.merge_by_precedence([shaped(s) for s in sources], ["location_code", "year"], [F.col("population").desc_nulls_last()])
    full = joins.year_grid(merged, ["location_code"], "year", *grid)
    full = windows.interpolate(full, ["location_code"], "year", "population", flag="population_is_interpolated")
    full = windows.fill(full, ["location_code"], "year", ["location"], "both")
    full = windows.fill(full, ["location_code"], "year", ["density_per_km2", "growth_rate"], "both" if back_fill else "forward")
    return full.where("population IS NOT NULL").withColumn(
        "source", F.when(F.col("population_is_interpolated"), F.lit(interpolated_source)).otherwise(F.col("source"))
    )


def hourly_weather(
    matrices: dict[str, DataFrame], time_col: str, cities: dict[str, list[str]], period: str = "daily",
) -> DataFrame:
    """Hourly city matrices to country weather per day or year.

    `matrices` maps a metric name to its wide table, `cities` a country code to its city columns.
    """
    frames = []
    for code, columns in cities.items():
        parts = []
        for metric, df in matrices.items():
            name, offset = schema.HOURLY_METRICS[metric]
            stamp = F.col(time_col)
            key = F.to_date(stamp) if period == "daily" else F.year(stamp)
            part = aggregates.matrix_mean(df, key, "_period", columns, name, offset, bounds=period == "daily")
            parts.append(part)
        # A period may lack one metric, so the metrics are stacked and merged by one aggregate.
        names = [c for p in parts for c in p.columns if c != "_period"]
        stacked = reshape.union_all(parts, missing=True)
        merged = stacked.groupBy("_period").agg(*(F.max(c).alias(c) for c in names))
        frames.append(merged.withColumns({"location_code": F.lit(code), "city_count": F.lit(len(columns))}))
    out = reshape.union_all(frames)
    if period == "daily":
        out = out.withColumnRenamed("_period", "date").withColumns({
            "year": F.year("date"),
            "weather_match_level": F.lit("historical_hourly_daily_city_mean"),
        })
        renames = {"temperature_mean_min": "temperature_min", "temperature_mean_max": "temperature_max", "wind_speed_mean_max": "wind_speed_max"}
        return out.withColumnsRenamed(renames)
    return out.withColumnRenamed("_period", "year").withColumns({
        "date": calendar.year_end("year"),
        "weather_match_level": F.lit("historical_hourly_annual_city_mean"),
    })


def report_pages(pages: DataFrame, inventory: DataFrame, key: str = "page_url") -> DataFrame:
    """Report page index: newest download per page, period, category, numbers, attachment completeness.

    `key` tells pages apart: by url, or by the stored file where several pages have one url. Records without it are
    left out. `inventory` lists the files present, one `path` per row, with forward slashes.
    """
    latest = windows.keep_latest(
        pages.where(F.col(key).isNotNull()), [key],
        [text.parse_timestamp("downloaded_at").desc_nulls_last(), F.col("content_hash").desc()],
    )
    title = F.coalesce(text.blank_to_null("anchor_title"), text.blank_to_null("title"), F.lit(""))
    body = F.concat_ws("\n", title, F.coalesce("text_preview", F.lit("")))
    week_year = text.extract_field(body, schema.REPORT_WEEK_PATTERN, "int", 1)
    month_year = text.extract_field(title, schema.REPORT_MONTH_PATTERN, "int", 1)
    rows = latest.select(
        F.col(key).alias("_page"), "page_url",
        title.alias("report_title"),
        text.classify(title, schema.REPORT_CATEGORIES, schema.REPORT_CATEGORY_DEFAULT).alias("report_category"),
        text.page_role("page_url").alias("record_role"),
        text.parse_date("published_date", "yyyy-MM-dd").alias("published_date"),
        F.coalesce(week_year, month_year).alias("report_year"),
        text.extract_field(body, schema.REPORT_WEEK_PATTERN, "int", 2).alias("report_week"),
        text.extract_field(title, schema.REPORT_MONTH_PATTERN, "int", 2).alias("report_month"),
        *text.extract_fields(body, schema.REPORT_NUMBER_PATTERNS),
        F.coalesce(F.size("attachment_urls"), F.lit(0)).alias("attachment_url_count"),
        F.to_json("attachment_urls").alias("attachment_urls_json"),
        F.to_json("local_attachment_paths").alias("local_attachment_paths_json"),
        F.transform("local_attachment_paths", lambda p: F.replace(p, F.lit("\\"), F.lit("/"))).alias("_paths"),
        F.replace(F.col("local_html_path"), F.lit("\\"), F.lit("/")).alias("_html"),
    )
    files = joins.listed_files_present(rows, "_page", "_paths", inventory, "path").select(
        "_page", F.col("listed_count").alias("local_attachment_count"), F.col("existing_count").alias("existing_attachment_count"),
    )
    present = inventory.select(F.col("path").alias("_html")).distinct().withColumn("_there", F.lit(True))
    out = rows.join(files, "_page", "left").join(present, "_html", "left")
    influenza = F.col("report_category") == "Influenza surveillance"
    return out.withColumns({
        "disease": F.when(influenza, "Influenza"),
        "stat_period": text.period_label(F.col("report_year"), F.col("report_week"), F.col("report_month")),
        "attachments_complete": (F.col("existing_attachment_count") == F.col("local_attachment_count"))
        & (F.col("local_attachment_count") == F.col("attachment_url_count")),
        "local_html_exists": F.coalesce("_there", F.lit(False)),
        "numeric_extraction_status": F.when(influenza, "summary_text_only").otherwise("metadata_only"),
    }).drop("_page", "_paths", "_html", "_there")


def indicator_catalog(raw: DataFrame, locations: DataFrame, current_year: int) -> DataFrame:
    """Indicator records to a catalog with one row per business key and its provenance.

    Input: the indicator columns plus source_file, topic and indicator (from the file name).
    """
    rows = records.json_record(raw, "raw_json").drop("raw_json")
    rows = rows.withColumns({
        "collector_topic": F.col("topic"),
        "indicator_code": F.trim(F.coalesce("indicator_code", "indicator")),
        "indicator_name": F.trim(F.coalesce("indicator_name", F.lit(""))),
        "location_code": F.upper(F.trim("location_code")),
        "location_type": F.upper(F.trim("location_type")),
        "year": text.parse_number("year").cast("int"),
        "numeric_value_clean": F.coalesce(text.parse_number("numeric_value"), text.parse_number("value")),
        "low": text.parse_number("low"),
        "high": text.parse_number("high"),
    })
    selected = locations.select("location_code", F.lit(True).alias("_selected")).distinct()
    rows = rows.join(selected, "location_code", "left").withColumns({
        "date": F.when(F.col("year").between(1, 9999), calendar.year_end("year")),
        "unit": text.resolve_unit("unit", "indicator_code", "indicator_name", schema.INDICATOR_UNITS),
        "sex": records.backfill_dimension("sex", "SEX"),
        "age": records.backfill_dimension("age", "AGEGROUP"),
        "is_selected_country": F.coalesce(
            (F.col("location_type") == "COUNTRY") & F.col("_selected"), F.lit(False)
        ),
        "collector_topic_match": text.topic_matches("collector_topic", "indicator_code", "indicator_name"),
    })
    rows = rows.withColumn(
        "usage_class", text.usage_class("collector_topic", "indicator_code", "indicator_name", F.col("collector_topic_match"))
    )
    rows = rows.withColumn("quality_flag", measures.quality_flag([
        (F.col("year").isNull(), "invalid_year"),
        (F.col("year") > current_year, "future_year"),
        (F.col("usage_class") == "keyword_false_positive", "keyword_false_positive"),
        (F.col("numeric_value_clean").isNull(), "non_numeric_reference"),
    ]))
    rows = rows.withColumns({
        "_key": records.record_key("indicator_code", "who_record_id", schema.DEDUP_COLUMNS),
        "_signature": F.unhex(F.sha2(records.joined(schema.SIGNATURE_COLUMNS), 256)),
    })
    kept = [c for c in rows.columns if c not in ("_key", "_signature", "_selected", "topic", "indicator")]
    out = aggregates.latest_with_provenance(rows, "_key", "source_file", "collector_topic", "_signature", [
        text.parse_timestamp("who_record_updated_at"), F.col("collector_topic_match"), F.col("source_file"), F.col("_signature"),
    ], kept)
    conflict = F.col("duplicate_content_conflict") & (F.col("quality_flag") == "ok")
    return out.withColumn(
        "quality_flag", F.when(conflict, "duplicate_content_conflict_latest_kept").otherwise(F.col("quality_flag"))
    ).drop("_key")


def primary_observations(catalog: DataFrame, locations: DataFrame) -> DataFrame:
    """Curated annual series of the primary indicator, prevalence alongside."""
    selected = catalog.where("is_selected_country")
    keys = ["location_code", "year"]

    def one(code: str) -> DataFrame:
        rows = selected.where((F.col("indicator_code") == code) & F.col("numeric_value_clean").isNotNull())
        return windows.keep_latest(rows, keys, [F.col("numeric_value_clean").desc()])

    main = one(schema.PRIMARY_INDICATOR).where("numeric_value_clean >= 0").select(
        *keys, F.col("numeric_value_clean").alias("value"), F.col("low").alias("who_estimate_low"),
        F.col("high").alias("who_estimate_high"), F.col("indicator_name").alias("who_indicator_name"),
    )
    prevalence = one(schema.PREVALENCE_INDICATOR).select(
        *keys, F.col("numeric_value_clean").alias("hiv_prevalence_adults_percent"),
        F.col("low").alias("hiv_prevalence_adults_percent_low"), F.col("high").alias("hiv_prevalence_adults_percent_high"),
    )
    names = locations.select("location_code", F.col("location").alias("_name"))
    rows = main.join(prevalence, keys, "left").join(names, "location_code", "left").withColumn(
        "location", F.coalesce("_name", "location_code")
    )
    has_interval = F.col("who_estimate_low").isNotNull() & F.col("who_estimate_high").isNotNull()
    core = observation(
        rows, disease="HIV/AIDS", date=calendar.year_end("year"), frequency="annual", period_days=365,
        metric="new_infections", metric_label="年度新增 HIV 感染数", source=f"WHO GHO {schema.PRIMARY_INDICATOR}",
        is_negative_case_correction=F.lit(False), is_negative_death_correction=F.lit(False),
        quality_flag=measures.quality_flag([(has_interval, "who_estimate_with_interval")]),
    )
    extra = rows.select(*keys, "who_estimate_low", "who_estimate_high", "hiv_prevalence_adults_percent")
    return core.join(extra, keys)


def auxiliary_indicators(catalog: DataFrame) -> DataFrame:
    """Curated auxiliary indicators, one row per (code, year), three columns each."""
    rows = catalog.where(F.col("is_selected_country") & F.col("numeric_value_clean").isNotNull()).select(
        "location_code", "year", "indicator_code", F.col("numeric_value_clean").alias("v"), "low", "high"
    )
    wide = joins.pivot_indicators(rows, ["location_code", "year"], "indicator_code", schema.AUXILIARY_INDICATORS, ["v", "low", "high"])
    return wide.withColumn("date", calendar.year_end("year"))


def canonical(sources: list[DataFrame]) -> DataFrame:
    """Union of the sources by name; one row per (location, disease, date), the later source wins."""
    return joins.merge_by_precedence(
        sources, ["location_code", "disease", "date"], [F.col("value").desc_nulls_last(), F.col("source")]
    )
