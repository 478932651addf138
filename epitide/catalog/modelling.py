"""Registered queries: splits, baselines, trees, sequence data, dashboard questions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from epitide import schema
from epitide.catalog import reporting
from epitide.catalog.assembling import CATALOG_SQL, silver_catalog
from epitide.catalog.registry import Registry
from epitide.catalog.summarising import metrics_sql
from epitide.catalog.views import GOLD_INPUTS, SERIES
from epitide.functions import measures
from epitide.operators import aggregates
from epitide.plans import forecasting, quality, serving
from epitide.sources import scratch, sinks

Q = Registry()
MODELS = ["naive_last_value", "moving_average"]
DAYS = "greatest(max(date) over () - min(date) over (), 1)"


def split_sql(source: str, columns: str) -> str:
    return f"""select {columns}, case when date <= lo + cast(floor(days * 0.7) as int) then 'train' when date <= lo + cast(floor(days * 0.85) as int) then 'validation' else 'test' end as split
        from (select *, min(date) over () as lo, {DAYS} as days from ({source}))"""


@Q.add("mlt01_chronological_split", split_sql("select * from v_features where frequency = 'daily' and disease = 'COVID-19'", "location_code, disease, date"))
def _(v):
    rows = v.gold.where("frequency = 'daily' AND disease = 'COVID-19'")
    return forecasting.time_split(rows).select(*SERIES, "date", "split")


@Q.add("mlt02_last_value_baseline", "select location_code, disease, date, round(prediction_naive_last_value, 4) as prediction from v_scored")
def _(v):
    return v.scored.select(*SERIES, "date", F.round("prediction_naive_last_value", 4).alias("prediction"))


@Q.add("mlt03_moving_average_baseline", "select location_code, disease, date, round(prediction_moving_average, 4) as prediction from v_scored")
def _(v):
    return v.scored.select(*SERIES, "date", F.round("prediction_moving_average", 4).alias("prediction"))


_TEST = """select * from (select *, min(date) over (partition by disease) as lo, greatest(max(date) over (partition by disease) - min(date) over (partition by disease), 1) as days from v_scored where target_t_plus_7 is not null) where date > lo + cast(floor(days * 0.85) as int)"""
COMPARISON_SQL = metrics_sql(
    f"select disease, 'naive_last_value' as model, target_t_plus_7 as a, prediction_naive_last_value as p from ({_TEST}) union all select disease, 'moving_average', target_t_plus_7, prediction_moving_average from ({_TEST})", "disease, model"
)


@Q.add("mlt04_baseline_comparison", COMPARISON_SQL)
def _(v):
    return forecasting.baseline_comparison(v.gold)


@Q.add("mlt04_best_baseline", f"select disease, arg_min(model, (mae, model)) as best_model, min(mae) as best_mae, 'test' as selected_on from ({COMPARISON_SQL}) group by 1")
def _(v):
    return aggregates.best_model(forecasting.baseline_comparison(v.gold), ["disease"])


NUMERIC = list(schema.FEATURE_COLUMNS)


def training_rows(v):
    """Labelled rows with all feature columns; boosting reads its input once per tree, so they are kept as a table."""
    def write(path):
        rows = v.gold.where("disease = 'COVID-19' AND target_t_plus_7 IS NOT NULL AND lag_1 IS NOT NULL AND lag_7 IS NOT NULL")
        rows = rows.withColumn("target_log", measures.log_target("target_t_plus_7")).select(*SERIES, "date", "target_t_plus_7", "target_log", *NUMERIC)
        sinks.write_parquet(forecasting.time_split(forecasting.as_numeric(rows, NUMERIC)), path)

    return v.spark.read.parquet(v.kept("training", GOLD_INPUTS, write))


def trained_path(v):
    """Training rows and the folder of the fitted trees, one model for all questions of an application."""
    rows = training_rows(v)

    def write(path):
        forecasting.require_partitions(rows)
        train = rows.where("split = 'train'")
        sinks.save_model(forecasting.fit_gbt(train, forecasting.usable_numeric(train, NUMERIC)), path)

    return rows, v.kept("trees", GOLD_INPUTS, write)


def trained(v):
    rows, path = trained_path(v)
    return rows, sinks.load_model(path)


# Feature columns the given tables can fill; the others are empty and left out of the models.
IMPUTED = [c for c in NUMERIC if c not in ("density_per_km2", "urban_population_ratio")]
_LABELLED = "select * from v_features where disease = 'COVID-19' and target_t_plus_7 is not null and lag_1 is not null and lag_7 is not null"
_TRAINING = f"({split_sql(_LABELLED, '*')})"


@Q.add("mlt05_feature_stages", f"""select t.location_code, disease, date, coalesce(i.idx, (select count(distinct location_code) from {_TRAINING} where split = 'train'))::double as location_idx,
    {", ".join(f"round(coalesce(t.{c}::double, m.{c}), 4) + 0.0 as {c}_imp" for c in IMPUTED)} from {_TRAINING} t left join (select location_code, row_number() over (order by count(*) desc, location_code) - 1 as idx from {_TRAINING} where split = 'train' group by 1) i on i.location_code = t.location_code
    cross join (select {", ".join(f"median({c}::double) as {c}" for c in IMPUTED)} from {_TRAINING} where split = 'train') m""")
def _(v):
    """Frequency-ordered index of the location and exact train medians, for every feature column at once."""
    rows = training_rows(v)
    train = rows.where("split = 'train'")
    medians = forecasting.train_medians(train, forecasting.usable_numeric(train, NUMERIC))
    out = Pipeline(stages=forecasting.feature_stages(medians)).fit(train).transform(rows)
    empty = F.lit(None).cast("double")
    return out.select(*SERIES, "date", "location_idx", *((F.round(f"{c}_imp", 4) if c in medians else empty).alias(f"{c}_imp") for c in IMPUTED))


@Q.add("mlt06_gradient_boosted_trees")
def _(v):
    rows, model = trained(v)
    test = forecasting.gbt_predict(model, rows.where("split = 'test'"))
    return test.select(*SERIES, "date", F.col("target_t_plus_7").alias("actual_t_plus_7"), F.round("prediction_gbt", 4).alias("prediction_gbt"), "rolling_mean_7")


def by_model_and_nodes(v):
    """Test rows with the forecast of the reloaded model and that of its node relation."""
    rows, path = trained_path(v)
    assembled = sinks.load_model(path).transform(rows.where("split = 'test'"))
    assembled = assembled.withColumn("prediction_gbt", measures.inverse_log_target("prediction_log"))
    return forecasting.predict_with_nodes(assembled, forecasting.tree_nodes(v.spark, path))


SAME = "abs(prediction_gbt - prediction_nodes) <= 1e-6 * greatest(abs(prediction_gbt), 1)"


@Q.add("mlt06_tree_nodes", f"select location_code, disease, date, target_t_plus_7 as actual_t_plus_7, round(rolling_mean_7, 4) as rolling_mean_7, true as same_by_nodes from {_TRAINING} where split = 'test'")
def _(v):
    """The forecast of the fitted model against the walk over its nodes, row by row."""
    return by_model_and_nodes(v).select(*SERIES, "date", F.col("target_t_plus_7").alias("actual_t_plus_7"), F.round("rolling_mean_7", 4).alias("rolling_mean_7"), F.expr(SAME).alias("same_by_nodes"))


@Q.add("mlt07_model_evaluation")
def _(v):
    rows, model = trained(v)
    test = forecasting.gbt_predict(model, rows.where("split = 'test'"))
    return forecasting.evaluate(test, {"gbt": "prediction_gbt", "moving_average": "rolling_mean_7"}, "moving_average")


_BASELINE = metrics_sql(f"select 'moving_average' as model, target_t_plus_7 as a, rolling_mean_7 as p from {_TRAINING} where split = 'test'", "model")


@Q.add("mlt07_node_evaluation", f"select *, true as same_gbt_metrics, mae as baseline_mae, false as beats_baseline, true as gbt_flag_consistent from ({_BASELINE})")
def _(v):
    """Metrics of the baseline, and whether model and node relation are evaluated alike and flagged by their MAE."""
    scored = by_model_and_nodes(v)
    out = forecasting.evaluate(scored, {"gbt": "prediction_gbt", "nodes": "prediction_nodes", "moving_average": "rolling_mean_7"}, "moving_average")
    def of(model, column):
        return F.max(F.when(F.col("model") == model, F.col(column)))

    gaps = [F.abs(of("gbt", c) - of("nodes", c)) for c in ("mae", "rmse", "r2")]
    checks = out.agg(
        (gaps[0] + gaps[1] + gaps[2] < 1e-4).alias("same_gbt_metrics"),
        (of("gbt", "beats_baseline") == (of("nodes", "mae") < of("nodes", "baseline_mae"))).alias("gbt_flag_consistent"),
    )
    return aggregates.attach(out.where("model = 'moving_average'"), checks)


@Q.add("snk07_model_persistence")
def _(v):
    rows, model = trained(v)
    path = scratch.shared_dir(v.spark, "model")
    sinks.save_model(model, path)
    return forecasting.gbt_predict(sinks.load_model(path), rows.where("split = 'test'")).select(*SERIES, "date", "prediction_gbt")


@Q.add("snk07_nodes_after_reload", "select tree, true as same_nodes, true as is_binary_tree from (select unnest(generate_series(0, 59)) as tree)")
def _(v):
    """Node relations of a model and of its copy that was saved, loaded and saved again, tree by tree."""
    _, path = trained_path(v)
    again = scratch.shared_dir(v.spark, "model")
    sinks.save_model(sinks.load_model(path), again)

    def trees(folder):
        nodes = forecasting.tree_nodes(v.spark, folder)
        digest = F.xxhash64("node", "weight", "feature", "threshold", "categories", "left", "right", "value").cast("decimal(38,0)")
        return nodes.groupBy("tree").agg(F.count("*").alias("n"), F.count_if(F.col("left") < 0).alias("leaves"), F.sum(digest).alias("digest"))

    a, b = trees(path), trees(again).select("tree", F.col("digest").alias("copy"), F.col("n").alias("copy_n"))
    return a.join(b, "tree", "full").select(
        F.col("tree").cast("long"), (F.col("digest").eqNullSafe(F.col("copy")) & F.col("n").eqNullSafe(F.col("copy_n"))).alias("same_nodes"), (F.col("n") == 2 * F.col("leaves") - 1).alias("is_binary_tree")
    )


@Q.add("mlt08_winning_prediction", f"""select f.location_code, f.disease, f.date, b.best_model, round(case when b.best_model = 'naive_last_value' then prediction_naive_last_value else prediction_moving_average end, 4) as prediction
    from v_scored f left join (select disease, arg_min(model, (mae, model)) as best_model from ({COMPARISON_SQL}) group by 1) b on b.disease = f.disease""")
def _(v):
    out = forecasting.select_best(forecasting.baselines(v.gold), forecasting.baseline_comparison(v.gold), MODELS)
    return out.select(*SERIES, "date", "best_model", F.round("prediction_t_plus_7", 4).alias("prediction"))


W = "partition by location_code, disease order by date"
DAILY_CALENDAR = "cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date)"
WEEKLY_CALENDAR = "cast(unnest(generate_series(min(date), max(date), interval 7 day)) as date)"
ANNUAL_CALENDAR = "make_date(cast(unnest(generate_series(year(min(date)), year(max(date)))) as int), 12, 31)"


def regular_sql(source: str, calendar: str, gap: int) -> str:
    """Series on their calendar; up to `gap` missing periods in a row are interpolated by days."""
    known, ahead = "rows between unbounded preceding and current row", "rows between current row and unbounded following"
    return f"""select *, x is null and pos - p0 <= {gap} and d1 is not null as is_imputed, coalesce(x, case when pos - p0 <= {gap} and d1 is not null then y0 + (y1 - y0) * ((date - d0) / (d1 - d0)) end) as filled from (select *,
    last_value(case when x is not null then pos end ignore nulls) over ({W} {known}) as p0, last_value(case when x is not null then date end ignore nulls) over ({W} {known}) as d0, first_value(case when x is not null then date end ignore nulls) over ({W} {ahead}) as d1,
    last_value(x ignore nulls) over ({W} {known}) as y0, first_value(x ignore nulls) over ({W} {ahead}) as y1
    from (select k.location_code, k.disease, k.date, s.value as x, row_number() over (partition by k.location_code, k.disease order by k.date) as pos from (select location_code, disease, {calendar} as date from {source} group by 1, 2) k
    left join {source} s on s.location_code = k.location_code and s.disease = k.disease and s.date = k.date))"""


def sequence_sql(regular: str, length: int, horizon: int, average: int) -> str:
    frame = f"{W} rows {length - 1} preceding"
    return f"""select *, case when target is null then 'forecast_only' when date <= lo + cast(floor(days * 0.7) as int) then 'train' when date <= lo + cast(floor(days * 0.85) as int) then 'validation' else 'test' end as split from (select *, min(case when target is not null then date end) over () as lo,
    greatest(max(case when target is not null then date end) over () - min(case when target is not null then date end) over (), 1) as days from (select *, count(filled) over ({frame}) as c, lag(filled, {length - 1}) over ({W}) as first_value, sum(filled) over ({frame}) as window_sum,
    sum(ln(1 + filled)) over ({frame}) as log_sum, sum(ln(1 + filled) * ln(1 + filled)) over ({frame}) as log_square, lead(x, {horizon}) over ({W}) as target, avg(filled) over ({W} rows {average - 1} preceding) as moving_average from ({regular})) where c = {length} and x is not null)"""


# Daily event series on their calendar; single missing days are interpolated.
REGULAR_SQL = regular_sql("v_series", DAILY_CALENDAR, 1)
SEQUENCE_SQL = sequence_sql(REGULAR_SQL, 6, 2, 7)
SEQUENCE_OUT = "location_code, disease, date, first_value, round(window_sum, 4) as window_sum, target, x as current_value, round(moving_average, 4) as moving_average, split"


def sequence_columns(rows):
    return rows.select(
        *SERIES, "date", F.element_at("input_window", 1).alias("first_value"), F.round(F.aggregate("input_window", F.lit(0.0), lambda a, x: a + x), 4).alias("window_sum"), "target", "current_value",
        F.round("moving_average", 4).alias("moving_average"), "split",
    )


def sequences(v):
    rows = v.series_daily.withColumn("frequency", F.lit("daily"))
    return forecasting.sequence_set(rows, 6, "daily", horizon=2, max_gap=1, value="value")


@Q.add("mlt09_sequence_training_set", f"select {SEQUENCE_OUT} from ({SEQUENCE_SQL})")
def _(v):
    return sequence_columns(sequences(v))


WEEKLY_SQL = sequence_sql(regular_sql("(select * from v_obs where frequency = 'weekly')", WEEKLY_CALENDAR, schema.MAX_GAP["weekly"]), 8, schema.HORIZON_STEPS["weekly"], schema.ROLLING_WINDOW["weekly"])
ANNUAL_SQL = sequence_sql(regular_sql("(select * from v_obs where frequency = 'annual')", ANNUAL_CALENDAR, schema.MAX_GAP["annual"]), 3, schema.HORIZON_STEPS["annual"], schema.ROLLING_WINDOW["annual"])


@Q.add("mlt09_weekly_sequences", f"select {SEQUENCE_OUT} from ({WEEKLY_SQL})")
def _(v):
    return sequence_columns(forecasting.sequence_set(v.weekly_obs, 8, "weekly", value="value"))


@Q.add("mlt09_annual_sequences", f"select {SEQUENCE_OUT} from ({ANNUAL_SQL})")
def _(v):
    return sequence_columns(forecasting.sequence_set(v.annual_obs, 3, "annual", value="value"))


def standardised_sql(sequence: str, length: int) -> str:
    scaler = f"(select sum(log_sum) / ({length} * count(*)) as m, sqrt(greatest(sum(log_square) / ({length} * count(*)) - pow(sum(log_sum) / ({length} * count(*)), 2), 0)) as s from ({sequence}) where split = 'train')"
    return f"select location_code, disease, date, round((log_sum - {length} * m) / coalesce(nullif(s, 0), 1), 4) as input_scaled_sum, round((ln(1 + target) - m) / coalesce(nullif(s, 0), 1), 4) as target_scaled, split from ({sequence}) cross join {scaler}"


def standardised_columns(rows):
    total = F.aggregate("input_scaled", F.lit(0.0), lambda a, x: a + x)
    return forecasting.standardise(rows).select(*SERIES, "date", F.round(total, 4).alias("input_scaled_sum"), F.round("target_scaled", 4).alias("target_scaled"), "split")


@Q.add("mlt09_standardised", standardised_sql(SEQUENCE_SQL, 6))
def _(v):
    """Windows and targets on the log scale, by mean and deviation of the train windows."""
    return standardised_columns(sequences(v))


@Q.add("mlt09_weekly_standardised", standardised_sql(WEEKLY_SQL, 8))
def _(v):
    return standardised_columns(forecasting.sequence_set(v.weekly_obs, 8, "weekly", value="value"))


@Q.add("mlt09_train_only_scaler", f"select round(sum(log_sum) / (6 * count(*)), 4) as mean, round(sqrt(sum(log_square) / (6 * count(*)) - pow(sum(log_sum) / (6 * count(*)), 2)), 4) as std from ({SEQUENCE_SQL}) where split = 'train'")
def _(v):
    return forecasting.log_scaler(sequences(v)).select(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@Q.add("mlt09_counters", f"""select count(case when x is null then 1 end) as calendar_rows_inserted, count(case when is_imputed then 1 end) as input_values_imputed, count(case when x is not null and pos >= 6 and c < 6 then 1 end) as windows_skipped from (select *, count(filled) over ({W} rows 5 preceding) as c from ({REGULAR_SQL}))""")
def _(v):
    return forecasting.sequence_counters(v.series_daily.withColumn("frequency", F.lit("daily")), 6, "daily", "value", 1)


@Q.add("mlt10_prediction_table", f"select 'window_mean' as model, location_code, disease, date, target as actual_t_plus_7, round(window_sum / 6, 4) as prediction, round(window_sum / 6 - target, 4) as error, split from ({SEQUENCE_SQL})")
def _(v):
    mean = F.aggregate("input_window", F.lit(0.0), lambda a, x: a + x) / 6
    out = forecasting.prediction_rows(sequences(v), mean, "window_mean")
    return out.select("model", *SERIES, "date", "actual_t_plus_7", F.round("prediction", 4).alias("prediction"), F.round("error", 4).alias("error"), "split")


@Q.add("mlt11_prediction_export", """select location_code, disease, date, round(target_t_plus_7, 4) as actual_t_plus_7, round(prediction_t_plus_7, 4) as prediction, round(prediction_t_plus_7 - target_t_plus_7, 4) as error, round(prediction_naive_last_value, 4) as prediction_naive_last_value
    from v_scored where target_t_plus_7 is not null""")
def _(v):
    out = forecasting.prediction_export(v.scored, ["naive_last_value"], None)
    return out.select(*SERIES, "date", *(F.round(c, 4).alias(c) for c in ("actual_t_plus_7", "prediction", "error", "prediction_naive_last_value")))


# -- dashboard questions -----------------------------------------------------------

@Q.add("qry01_overview", f"""select min(date) as start_date, max(date) as end_date, count(distinct location_code) as regions, count(distinct disease) as diseases, count(*) as valid_records, round(1 - ({" + ".join(f"avg(case when {c} is null then 1.0 else 0.0 end)" for c in schema.REQUIRED_OBSERVATION)}) / {len(schema.REQUIRED_OBSERVATION)}, 4)::double as data_completeness,
    (select sum(total_cases) from v_latest where disease = 'COVID-19') as current_total_cases, (select sum(total_deaths) from v_latest where disease = 'COVID-19') as current_total_deaths, (select sum(value) from v_latest where disease = 'COVID-19') as current_new_cases,
    (select count(*) from v_risk where disease = 'COVID-19') as risk_comparison_regions, (select count(*) >= 2 and bool_or(comparable) from v_risk where disease = 'COVID-19') as risk_comparable,
    (select case when count(*) >= 2 and bool_or(comparable) then count(case when risk_level = '高风险' then 1 end) end from v_risk where disease = 'COVID-19') as high_risk_regions,
    (select arg_min(model, (mae, model)) from ({COMPARISON_SQL}) where disease = 'COVID-19') as best_model, (select min(mae) from ({COMPARISON_SQL}) where disease = 'COVID-19') as best_model_mae from v_scored""")
def _(v):
    return serving.overview(v.scored, "COVID-19", v.risk, forecasting.baseline_comparison(v.gold))


@Q.add("qry02_overview_selected", f"""select p.location_code, p.disease, min(p.date) as start_date, max(p.date) as latest_date, arg_max(value, p.date) as current_new_cases, max(case when value <> 0 then p.date end) as last_nonzero_date, 0::bigint as trailing_zero_periods, false as reporting_stale,
    max(r.n) as risk_comparison_regions, case when max(r.n) >= 2 and bool_or(r.any_c) then max(r.high) end as high_risk_regions, max(r.n) >= 2 and bool_or(r.any_c) as risk_comparable, max(b.best_model) as best_model
    from (select * from v_scored where date between '1998-01-01' and '1999-12-31') p left join (select disease, count(*) as n, bool_or(comparable) as any_c, count(case when risk_level = '高风险' then 1 end) as high from v_risk group by 1) r on r.disease = p.disease
    left join (select disease, arg_min(model, (mae, model)) as best_model from ({COMPARISON_SQL}) group by 1) b on b.disease = p.disease group by 1, 2""")
def _(v):
    best = aggregates.best_model(forecasting.baseline_comparison(v.gold), ["disease"]).select("disease", "best_model")
    out = serving.overview_selected(v.scored, v.risk, best, start="1998-01-01", end="1999-12-31")
    return out.select(
        *SERIES, "start_date", "latest_date", "current_new_cases", "last_nonzero_date", "trailing_zero_periods", "reporting_stale", "risk_comparison_regions", "high_risk_regions", "risk_comparable", "best_model"
    )


@Q.add("qry03_trend", """select location_code, disease, date, date + 7 as forecast_target_date, value as actual, round(rolling_mean_7, 4) as rolling_7, round(prediction_moving_average, 4) as prediction, round(prediction_moving_average * 0.85, 4) as lower, round(prediction_moving_average * 1.15, 4) as upper
    from v_scored where location_code = 'NAD' and disease = 'COVID-19' and date between '1997-01-01' and '1999-06-30'""")
def _(v):
    # A learned model is served from its own prediction column.
    learned = v.scored.withColumn("prediction_learned", F.col("prediction_moving_average"))
    code = serving.resolve_location(v.catalog, "nation_3")
    out = serving.trend(learned, code, "covid-19", "1997-01-01", "1999-06-30", "learned")
    return out.select(*SERIES, "date", "forecast_target_date", "actual", *(F.round(c, 4).alias(c) for c in ("rolling_7", "prediction", "lower", "upper")))


@Q.add("qry03_trend_profile", """select location_code, disease, cast(max(date) - min(date) + 1 as int) as expected_calendar_days, count(*) as observed_rows, cast(max(date) - min(date) + 1 - count(*) as bigint) as date_gap_count from v_obs where disease = 'COVID-19' group by 1, 2""")
def _(v):
    return serving.trend_profile(v.obs, None, "COVID-19").select(*SERIES, "expected_calendar_days", "observed_rows", "date_gap_count")


@Q.add("qry04_predictions", """select location_code, disease, date, 'naive_last_value' as model, round(target_t_plus_7, 4) as actual_t_plus_7, round(prediction_naive_last_value, 4) as prediction, round(prediction_naive_last_value - target_t_plus_7, 4) as error from v_scored where disease = 'Influenza' and target_t_plus_7 is not null""")
def _(v):
    out = serving.predictions(v.scored, disease="influenza", model="naive_last_value")
    return out.withColumns({c: F.round(c, 4) for c in ("actual_t_plus_7", "prediction", "error")})


_MATCHED = "select * from v_features where temperature_mean is not null and relative_humidity_mean is not null and new_cases_smoothed is not null"
CORR_SQL = "case when count(*) >= 3 and stddev_pop({x}) > 0 and stddev_pop(new_cases_smoothed) > 0 then round(corr({x}, new_cases_smoothed), 4) end"


@Q.add("qry05_weather_correlation", f"""select location_code, disease, count(*) as sample_size, {CORR_SQL.format(x='temperature_mean')} as temperature_correlation, {CORR_SQL.format(x='relative_humidity_mean')} as humidity_correlation, bool_or(f) as fallback_used, min(date) as matched_start, max(date) as matched_end
    from (select *, max(case when date between '1996-02-01' and '1996-02-20' then 1 else 0 end) over (partition by location_code, disease) = 0 as f from ({_MATCHED})) where f or date between '1996-02-01' and '1996-02-20' group by 1, 2""")
def _(v):
    return serving.weather_correlation(v.gold, start="1996-02-01", end="1996-02-20")


@Q.add("qry06_risk_map", "select location_code, disease, risk_score, risk_level from v_risk where disease = 'Influenza'")
def _(v):
    return serving.risk_map(v.scored, "Influenza").select(*SERIES, "risk_score", "risk_level")


@Q.add("qry07_rankings", " union all ".join(
    f"select '{n}' as ranking, row_number() over (order by coalesce({c}, 0) desc, location_code, disease) as position, location_code, disease from v_risk where disease = 'COVID-19'" for n, c in (("risk", "risk_score"), ("growth", "growth_rate_7"), ("forecast", "forecast_cases"))))
def _(v):
    return serving.rankings(v.scored, "COVID-19").select("ranking", "position", *SERIES)


@Q.add("qry08_model_metrics", f"select * from ({COMPARISON_SQL}) where disease = 'COVID-19'")
def _(v):
    return forecasting.baseline_comparison(v.gold.where("disease = 'COVID-19'"))


@Q.add("qry09_options", f"""select f.disease, unnest(['naive_last_value', 'moving_average']) as model, f.entries, f.start, f.end_date, f.start as default_start, f.end_date as default_end, coalesce(b.best_model, 'naive_last_value') as default_model
    from (select disease, count(distinct location_code) as entries, min(date) as start, max(date) as end_date from v_features group by 1) f left join (select disease, arg_min(model, (mae, model)) as best_model from ({COMPARISON_SQL}) group by 1) b on b.disease = f.disease""")
def _(v):
    """The options of each disease, one row per model."""
    out = serving.options(v.scored, MODELS, forecasting.baseline_comparison(v.gold))
    return out.select("disease", F.explode("models").alias("model"), F.col("location_count").alias("entries"), "start", F.col("end").alias("end_date"), "default_start", "default_end", "default_model")


@Q.add("qry09_option_rows", "select disease, count(distinct location_code) as location_count, min(date) as start, max(date) as end_date, min(frequency) as frequency, min(metric) as metric, case min(frequency) when 'daily' then 'daily' when 'weekly' then 'weekly' else 'annual' end as metric_label from v_features group by 1")
def _(v):
    out = serving.options(v.obs, MODELS)
    return out.select("disease", "location_count", "start", F.col("end").alias("end_date"), "frequency", "metric", "metric_label")


@Q.add("qry09_option_pages", """select disease, page, count(*) as entry_count, min(location_code) as first_location_code, max(location_code) as last_location_code from (select disease, location_code, (row_number() over (partition by disease order by location_code) - 1) // 10 as page from (select distinct disease, location_code from v_features)) group by 1, 2""")
def _(v):
    return serving.option_pages(v.scored, 10).drop("entries")


@Q.add("qry10_disease_share", "select disease, count(*) as record_count, count(distinct location_code) as location_count, min(date) as start_date, max(date) as end_date from v_obs group by 1")
def _(v):
    return serving.disease_share(v.obs)


@Q.add("qry11_data_quality", """select source, frequency, count(*) as rows, min(date) as start_date, max(date) as end_date, count(case when neg then 1 end) as negative_correction_count, count(case when has_weather then 1 end) as weather_matched_count, count(case when not has_weather then 1 end) as weather_unmatched_count,
    count(*) - count(population) as population_unmatched_count, round(avg(case when target_t_plus_7 is null then 1.0 else 0.0 end), 6)::double as missing_target, cast(count(*) - count(distinct (location_code, disease, date)) as bigint) as duplicate_count from v_features group by 1, 2""")
def _(v):
    """The served report, by source: records, corrections, matched covariates, missing targets, duplicates."""
    return quality.serving_report_by(v.gold, ["source", "frequency"])


@Q.add("qry12_source_status", f"""{reporting.STATUS_SQL} union all select 'gradient-boosted trees' as name, 'model' as rule, count(*) as rows, null::bigint as raw_rows, 0::bigint as primary_rows,
    case when least(count(case when split = 'train' then 1 end), count(case when split = 'validation' then 1 end), count(case when split = 'test' then 1 end)) > 0 then 'ok' else 'info' end as status from {_TRAINING}""")
def _(v):
    """One row for each source and for the learned model."""
    return quality.source_status(reporting.status_parts(v)).unionByName(quality.model_status(training_rows(v), "gradient-boosted trees"))


@Q.add("qry13_indicator_summary", f"""select indicator_code, min(indicator_name) as indicator_name, string_agg(distinct usage_class, ' | ') as usage_class, count(*) as rows, count(numeric_value_clean) as numeric_rows, count(case when is_selected_country then 1 end) as selected_country_rows,
    count(distinct case when is_selected_country then location_code end) as selected_country_count, min(year) as year_min, max(year) as year_max, cast(sum(duplicate_source_count - 1) as bigint) as duplicate_raw_rows, count(case when duplicate_content_conflict then 1 end) as duplicate_content_conflict_groups from ({CATALOG_SQL}) group by 1""")
def _(v):
    out = aggregates.indicator_summary(silver_catalog(v))
    return out.select(
        "indicator_code", "indicator_name", "usage_class", "rows", "numeric_rows", "selected_country_rows", "selected_country_count", "year_min", "year_max", "duplicate_raw_rows", "duplicate_content_conflict_groups"
    )


@Q.add("qry14_model_coverage", f"""select c.disease, m.model, m.mae, c.feature_rows, c.target_rows from (select disease, count(*) as feature_rows, count(target_t_plus_7) as target_rows from v_features group by 1) c join ({COMPARISON_SQL}) m on m.disease = c.disease""")
def _(v):
    out = quality.model_rows(quality.model_coverage(v.gold), forecasting.baseline_comparison(v.gold))
    return out.select("disease", "model", "mae", "feature_rows", "target_rows")


@Q.add("qry14_model_inputs", f"""select 'naive_last_value' as model, 'baseline' as kind, count(distinct disease) as diseases, count(*) as input_rows, 0::bigint as train_rows, 0::bigint as validation_rows, 0::bigint as test_rows, min(date) as date_start, max(date) as date_end, false as uses_weather from v_features
    union all select 'moving_average', 'baseline', count(distinct disease), count(*), 0, 0, 0, min(date), max(date), false from v_features union all select 'gbt', 'learned', count(distinct disease), count(*), count(case when split = 'train' then 1 end), count(case when split = 'validation' then 1 end), count(case when split = 'test' then 1 end), min(date), max(date), true from {_TRAINING}""")
def _(v):
    return quality.model_inputs(v.gold, MODELS, training_rows(v), "gbt")


@Q.add("qry15_series_filter", "select location_code, disease, date, value from v_obs where location_code = 'NAE' and lower(disease) = 'influenza' and date >= '1997-03-01' and date <= '1999-03-01'")
def _(v):
    return serving.filter_series(v.obs, " nae ", "INFLUENZA", "1997-03-01", "1999-03-01").select(*SERIES, "date", "value")


@Q.add("qry16_trend_documents", "select location_code, disease, count(*) as points, min(date) as first_date, max(date) as last_date from v_features group by 1, 2")
def _(v):
    docs = serving.trend_documents(v.gold, None)
    return docs.select(*SERIES, F.size("points").cast("long").alias("points"), F.element_at("points", 1)["date"].alias("first_date"), F.element_at("points", -1)["date"].alias("last_date"))
